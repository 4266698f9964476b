"""Queries of problem 9 with their checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm.packing import Plan, pack_by_plan
from kinloom.llm.tokens import count_tokens
from kinloom.sources.stage import Stage
from kinloom.sources.tables import table


def _packed(spark: SparkSession, sf_dir: str) -> list[tuple[str, int, DataFrame, Plan]]:
    """(kind, capacity, packed pieces, plan) for each kind of container."""
    stage = Stage(spark, "packing")
    sized = stage.write(table(spark, sf_dir, "documents").select("doc_id", count_tokens(F.col("text")).alias("n")))
    kinds = table(spark, sf_dir, "container_sizes").select("container_kind", "capacity_tokens").filter("capacity_tokens >= 1").collect()  # a fixed table
    return [(k["container_kind"], k["capacity_tokens"], *pack_by_plan(sized, "doc_id", F.col("n"), k["capacity_tokens"], stage)) for k in kinds]


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their container, for each kind of container."""
    packed = [df.select(F.lit(kind).alias("container_kind"), "*") for kind, _, df, _ in _packed(spark, sf_dir)]
    if not packed:
        return spark.createDataFrame([], "container_kind string, doc_id bigint, piece int, start bigint, n_tokens int, container_id bigint")
    return reduce(DataFrame.unionByName, packed)


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used by each kind, those of its plan, the least by the program's prices, and the share of room filled."""
    rows = []
    for kind, capacity, df, plan in _packed(spark, sf_dir):
        used = df.agg(F.countDistinct("container_id").alias("containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))
        filled = F.round(F.col("tokens") / (F.col("containers") * capacity), 6)
        rows.append(used.select(F.lit(kind).alias("container_kind"), "containers", F.lit(plan.containers).cast("bigint").alias("planned"), F.lit(plan.least).alias("lp_bound"), "tokens", filled.alias("filled")))
    if not rows:
        return spark.createDataFrame([], "container_kind string, containers bigint, planned bigint, lp_bound double, tokens bigint, filled double")
    return reduce(DataFrame.unionByName, rows)


QUERIES = {"p9_packed": p9_packed, "p9_fill": p9_fill}
ORACLES: dict[str, str] = {}
