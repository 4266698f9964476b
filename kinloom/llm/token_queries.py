"""Queries of problem 8 (tested by exact round trip; SQL cannot express them)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm.tokens import decode, encode
from kinloom.sources.tables import table


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", encode(F.col("text")).alias("ids"))


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text out of its ids again; true where it is the stored one (null and blank give '')."""
    documents = table(spark, sf_dir, "documents")
    back = documents.select("doc_id", "text", encode(F.col("text")).alias("ids")).withColumn("back", decode(F.col("ids")))
    return back.select("doc_id", (F.col("back") == F.coalesce("text", F.lit(""))).alias("same"))


QUERIES = {"p8_ids": p8_ids, "p8_round_trip": p8_round_trip}
ORACLES = {"p8_round_trip": "SELECT doc_id, true AS same FROM documents"}
