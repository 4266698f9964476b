"""Queries of problem 10 (tested on a fixture of cases and near misses; SQL cannot express them)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm.residue import residue_documents, share_of_residue
from kinloom.sources.tables import table


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_documents(table(spark, sf_dir, "documents"))


def p10_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of residue in every document."""
    return table(spark, sf_dir, "documents").select("doc_id", share_of_residue(F.col("text")).alias("residue_share"))


QUERIES = {"p10_found": p10_found, "p10_share": p10_share}
ORACLES: dict[str, str] = {}
