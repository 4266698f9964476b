"""Queries of problems 2 and 4 (iterative; tested on fixtures with known persons)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinloom.llm.mixture import cross_source_matches, registration_confidences
from kinloom.llm.rematch import same_source_variants
from kinloom.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_source_variants(table(spark, sf_dir, "ccd_master"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_source_matches(table(spark, sf_dir, "ccd_master"))


def p4_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate registrations of different sources, each with the posterior that they are one person."""
    return registration_confidences(table(spark, sf_dir, "ccd_master"))


QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p4_confidence": p4_confidence}
ORACLES: dict[str, str] = {}
