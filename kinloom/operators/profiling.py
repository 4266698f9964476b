"""Data quality per source and attribute, and values shared between sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions.normalize import valid_hkid

ATTRIBUTES = ("chi_surname", "chi_firstname", "eng_surname", "eng_firstname", "phone", "email", "birthday", "hksr_num", "hkid")


def _long(records: DataFrame) -> DataFrame:
    """(source, attribute, value) of canonical records; a missing source is ``''``."""
    values = F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value")) for a in ATTRIBUTES))
    return records.select(F.coalesce("source", F.lit("")).alias("source"), F.inline(values))


def profile_attributes(records: DataFrame) -> DataFrame:
    """(source, attribute, n_rows, present, coverage, distinct_values, duplicate_values, duplicate_rows, valid_rate).

    Values are counted first, then summed: two combining aggregations, so a value or
    a source that most rows share is no burden.  valid_rate is for hkid only.
    """
    counts = _long(records).groupBy("source", "attribute", "value").agg(F.count(F.lit(1)).alias("n"))
    filled = F.col("value").isNotNull()
    repeated = filled & (F.col("n") > 1)
    valid = F.col("attribute").eqNullSafe("hkid") & valid_hkid(F.col("value"))
    out = counts.groupBy("source", "attribute").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(filled, F.col("n")).otherwise(0)).alias("present"),
        F.count_if(filled).alias("distinct_values"),
        F.count_if(repeated).alias("duplicate_values"),
        F.sum(F.when(repeated, F.col("n")).otherwise(0)).alias("duplicate_rows"),
        F.sum(F.when(valid, F.col("n")).otherwise(0)).alias("_valid"),
    )
    rate = F.when(F.col("attribute") == "hkid", F.coalesce(F.try_divide("_valid", "present"), F.lit(0.0)))
    return out.select("source", "attribute", "n_rows", "present", (F.col("present") / F.col("n_rows")).alias("coverage"), "distinct_values", "duplicate_values", "duplicate_rows", rate.alias("valid_rate"))


def value_overlap(records: DataFrame) -> DataFrame:
    """(attribute, left_source, right_source, shared): distinct values both sources hold, pairs without any included.

    For each value the sources that hold it are gathered (their number is the bound),
    then pairs of sources are counted; nothing is joined on a value.
    """
    held = _long(records).filter("value IS NOT NULL").groupBy("attribute", "value").agg(F.sort_array(F.collect_set("source")).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("left_source"), b.alias("right_source")))))
    shared = held.filter(F.size("s") > 1).select("attribute", F.inline(pairs)).groupBy("attribute", "left_source", "right_source").agg(F.count(F.lit(1)).alias("shared"))
    sources = records.select(F.coalesce("source", F.lit("")).alias("source")).distinct().agg(F.sort_array(F.collect_set("source")).alias("s"))
    grid = sources.select(F.inline(pairs)).select(F.explode(F.array(*map(F.lit, ATTRIBUTES))).alias("attribute"), "left_source", "right_source")
    return grid.join(shared, ["attribute", "left_source", "right_source"], "left").select("attribute", "left_source", "right_source", F.coalesce("shared", F.lit(0)).alias("shared"))
