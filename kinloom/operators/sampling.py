"""Deterministic sampling by hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band(score: Column) -> Column:
    return F.when(score.isNull(), "unavailable").when(score < 0.55, "lt_055").when(score < 0.65, "055_065").when(score < 0.75, "065_075").when(score < 0.85, "075_085").otherwise("gte_085")


def stratum(pair: Column, score: Column, baseline_tier: Column, gated_tier: Column, routes: Column) -> Column:
    """Source pair, score band, agreement of models, identifier conflict and routes, joined by ``|``."""
    agree = F.when(baseline_tier == gated_tier, "models_agree").otherwise("models_disagree")
    conflict = F.when(gated_tier == "conflict_review", "id_conflict").otherwise("no_id_conflict")
    return F.concat_ws("|", pair, band(score), agree, conflict, F.array_join(routes, "+"))


def _digest(prefix: str, left: str, right: str) -> Column:
    return F.sha2(F.concat(F.lit(prefix), F.col(left), F.lit(":"), F.col(right)), 256)


def stratified_sample(df: DataFrame, size: int, seed: str, *, left: str = "left_id", right: str = "right_id", by: str = "stratum") -> DataFrame:
    """``size`` pairs: the least digest of each stratum first, then the least digests of all.

    Each stratum's representative comes from partial aggregation, so a stratum that
    holds most pairs is no burden; a size of 0 or less gives no rows.  Of a pair drawn
    more than once one row (the least by its other columns) represents the stratum.
    """
    hashed = df.withColumn("_d", _digest(f"{seed}:", left, right))
    if size <= 0:
        return hashed.limit(0).drop("_d")
    first = hashed.groupBy(by).agg(F.min("_d").alias("_least"))
    ranked = hashed.join(first, hashed[by].eqNullSafe(first[by])).drop(first[by])
    copies = Window.partitionBy(by, "_d").orderBy(*(F.col(c).cast("string") for c in df.columns))
    leads = (F.col("_d") == F.col("_least")) & (F.col("_copy") == 1)
    chosen = ranked.withColumn("_copy", F.row_number().over(copies)).orderBy((~leads).cast("int"), "_d").limit(size)
    return chosen.drop("_d", "_least", "_copy")


def within_share(share: float, seed: str, *, left: str = "left_id", right: str = "right_id") -> Column:
    """Whether a pair is among the least digests that ``share`` (of 1) of all pairs has."""
    if share >= 1:
        return F.lit(True)
    return _digest(f"{seed}:", left, right) < f"{int(share * 16**16):016x}"


def double_review(df: DataFrame, count: int, seed: str, *, left: str = "left_id", right: str = "right_id") -> DataFrame:
    """The ``count`` pairs of least digest."""
    return df.orderBy(_digest(f"double:{seed}:", left, right)).limit(max(0, count))


def training_sample(records: DataFrame, required: DataFrame, limit: int) -> DataFrame:
    """All required records, and of the others the least digests of record_id up to ``limit`` in all."""
    known = records.filter("coalesce(record_id, '') <> ''").dropDuplicates(["record_id"])
    asked = known.join(required.select("record_id").distinct(), "record_id", "left_semi")
    others = known.join(required.select("record_id").distinct(), "record_id", "left_anti")
    room = max(0, limit - asked.count())
    return asked.unionByName(others.orderBy(F.sha2("record_id", 256)).limit(room))


def partition_of(name: Column) -> Column:
    """calibration or held_out, by the name's digest, three to two."""
    number = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")
    return F.when(number % 5 < 3, "calibration").otherwise("held_out")


def numbered(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """``idx`` from 1 within each group."""
    return df.withColumn("idx", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
