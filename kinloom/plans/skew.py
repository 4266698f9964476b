"""Queries of problem 1: per-surname results although a few surnames hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.operators.keyed_rank import value_at_position
from kinloom.sources.tables import table


def _surnames(spark: SparkSession, sf_dir: str) -> DataFrame:
    master = table(spark, sf_dir, "ccd_master")
    both = F.array(
        *(F.struct(F.lit(c).alias("field"), F.col(c).alias("surname")) for c in ("eng_surname", "chi_surname"))
    )
    return (
        master.select(F.explode(both).alias("s"), "modified", "record_id")
        .select("s.field", "s.surname", "modified", "record_id")
        .filter(F.trim("surname") != "")
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_at_position(_surnames(spark, sf_dir), ["field", "surname"], "modified", "record_id")


def p1_surname_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Algebraic aggregates per surname: map-side combined, so hot surnames shuffle one state per partition."""
    return (
        _surnames(spark, sf_dir)
        .groupBy("field", "surname")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("modified").alias("first_modified"),
            F.max("modified").alias("last_modified"),
            F.min("record_id").alias("least_record_id"),
        )
    )


_SURNAMES_SQL = """
  SELECT 'eng_surname' AS field, eng_surname AS surname, modified, record_id FROM ccd_master
  UNION ALL
  SELECT 'chi_surname', chi_surname, modified, record_id FROM ccd_master
"""

QUERIES = {"p1_found": p1_found, "p1_surname_profile": p1_surname_profile}
ORACLES = {
    "p1_found": f"""
WITH s AS ({_SURNAMES_SQL}),
r AS (
  SELECT field, surname, record_id,
         row_number() OVER (PARTITION BY field, surname ORDER BY modified NULLS FIRST, record_id NULLS FIRST) - 1 AS k,
         count(*) OVER (PARTITION BY field, surname) AS n
  FROM s WHERE trim(surname, ' ') <> ''
)
SELECT field, surname, record_id FROM r WHERE k = (n - 1) // 2
""",
    "p1_surname_profile": f"""
SELECT field, surname, count(*) AS n, min(modified) AS first_modified, max(modified) AS last_modified,
       min(record_id) AS least_record_id
FROM ({_SURNAMES_SQL}) WHERE trim(surname, ' ') <> '' GROUP BY field, surname
""",
}
