"""Queries of problem 6 with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions.characters import ordinary_class
from kinloom.llm.visual_text import canonical_text, values_not_ordinary
from kinloom.sources.tables import table

FIELDS = ["chi_surname", "chi_firstname", "eng_surname"]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values_not_ordinary(table(spark, sf_dir, "ccd_master"), "record_id", FIELDS)


def p6_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three names of every row in one consistent form."""
    master = table(spark, sf_dir, "ccd_master")
    return master.select("record_id", *(canonical_text(F.col(f)).alias(f) for f in FIELDS))


QUERIES = {"p6_found": p6_found, "p6_canonical": p6_canonical}
ORACLES = {
    "p6_found": " UNION ALL ".join(
        f"SELECT record_id, '{f}' AS field FROM ccd_master WHERE regexp_matches({f}, '[^{ordinary_class()}]')" for f in FIELDS
    )
}
