"""Review labels as pure transforms: state of a pair, staleness, evidence for viewing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions.security import mask_identifier


def review_state(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(name, n_labels, status, final_label) derived from the labels alone.

    A reviewer's latest answer counts.  An adjudication (latest one) settles a pair
    whose answers disagree or hold an Unsure; a final label stands only where the
    pair is agreed or adjudicated.
    """
    valid = labels.filter("parent IS NOT NULL AND label IN ('Same', 'Different', 'Unsure')")
    order = F.struct("submitted_at", "idx", "label")
    own = valid.filter("coalesce(is_adjudication, 0) <> 1").groupBy("parent", "reviewer").agg(F.max_by("label", order).alias("label"))
    counts = own.groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "Unsure").alias("unsure"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    ruled = valid.filter("is_adjudication = 1 AND label <> 'Unsure'").groupBy("parent").agg(F.max_by("label", order).alias("ruling"))
    joined = pairs.select("name", "needs_double_review").join(counts, F.col("name") == counts["parent"], "left").drop("parent").join(ruled, F.col("name") == ruled["parent"], "left")
    n = F.coalesce("n", F.lit(0))
    required = F.when(F.col("needs_double_review") == 1, 2).otherwise(1)
    open_status = (
        F.when(n == 0, "Unreviewed")
        .when(F.col("unsure") > 0, "Needs Adjudication")
        .when(n < required, "Partially Reviewed")
        .when(F.col("lo") == F.col("hi"), "Agreed")
        .otherwise("Needs Adjudication")
    )
    status = F.when((open_status == "Needs Adjudication") & F.col("ruling").isNotNull(), "Adjudicated").otherwise(open_status)
    final = F.when(status == "Agreed", F.col("lo")).when(status == "Adjudicated", F.col("ruling"))
    return joined.select("name", n.alias("n_labels"), status.alias("status"), final.alias("final_label"))


def staleness(pairs: DataFrame, master: DataFrame) -> DataFrame:
    """(name, stale): a record of the pair is gone or was modified since the snapshot."""
    now = master.select("record_id", "modified")
    left = now.select(F.col("record_id").alias("left_record"), F.col("modified").alias("_l"))
    right = now.select(F.col("record_id").alias("right_record"), F.col("modified").alias("_r"))
    both = pairs.select("name", "left_record", "right_record", "left_modified_at", "right_modified_at").join(left, "left_record", "left").join(right, "right_record", "left")
    same = (F.col("_l") == F.col("left_modified_at")) & (F.col("_r") == F.col("right_modified_at"))
    return both.select("name", (~F.coalesce(same, F.lit(False))).alias("stale"))


def first_two_labels(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(name, label_a, label_b): the first two ordinary labels by idx of pairs for double review."""
    wanted = pairs.filter("needs_double_review = 1").select(F.col("name").alias("parent")).distinct()
    own = labels.filter("coalesce(is_adjudication, 0) <> 1").join(wanted, "parent", "left_semi")
    ordered = own.groupBy("parent").agg(F.slice(F.sort_array(F.collect_list(F.struct("idx", "submitted_at", "reviewer", "label"))), 1, 2).alias("l"))
    return ordered.filter(F.size("l") == 2).select(F.col("parent").alias("name"), F.col("l")[0]["label"].alias("label_a"), F.col("l")[1]["label"].alias("label_b"))


def evidence_view(pairs: DataFrame, records: DataFrame, *, sensitive: bool) -> DataFrame:
    """(name, attribute, left, right): values of both records; identifiers are masked unless ``sensitive``."""
    names = ("chi_surname", "chi_firstname", "eng_surname", "eng_firstname", "phone_num", "email", "birthday", "hksr_num", "hkid")
    left = records.select(F.col("record_id").alias("left_record"), *(F.col(a).alias(f"l_{a}") for a in names))
    right = records.select(F.col("record_id").alias("right_record"), *(F.col(a).alias(f"r_{a}") for a in names))
    both = pairs.select("name", "left_record", "right_record").join(left, "left_record").join(right, "right_record")

    def shown(c: str, a: str):
        plain = F.coalesce(F.col(f"{c}_{a}"), F.lit(""))
        return mask_identifier(plain) if a in ("hkid", "hksr_num") and not sensitive else plain

    rows = F.array(*(F.struct(F.lit(a).alias("attribute"), shown("l", a).alias("left"), shown("r", a).alias("right")) for a in names))
    return both.select("name", F.inline(rows))
