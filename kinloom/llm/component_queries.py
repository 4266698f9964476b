"""Queries of problem 5 with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm.components import registration_groups
from kinloom.sources.tables import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registration_groups(table(spark, sf_dir, "ccd_master"), table(spark, sf_dir, "ccd_master_matching"))


def p5_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups of each number of rows there are."""
    sizes = p5_found(spark, sf_dir).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return sizes.groupBy("n_rows").agg(F.count(F.lit(1)).alias("n_groups"))


_GROUPS_SQL = """
WITH RECURSIVE r AS (
  SELECT record_id, CASE WHEN coalesce(source, '') <> '' AND ccd_source_key IS NOT NULL THEN source ELSE '' END AS s,
         CASE WHEN coalesce(source, '') <> '' AND ccd_source_key IS NOT NULL THEN ccd_source_key ELSE record_id END AS k
  FROM ccd_master
),
reg AS (SELECT s, k, min(record_id) AS rep FROM r GROUP BY s, k),
l AS (
  SELECT DISTINCT p.rep AS a, coalesce(c.rep, p.rep) AS b
  FROM ccd_master_matching m JOIN r ON r.record_id = m.parent JOIN reg p ON p.s = r.s AND p.k = r.k
  LEFT JOIN reg c ON c.s = m.client AND c.k = m.client_id AND m.client <> '' AND m.client_id <> ''
),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT a, a FROM l UNION SELECT b, b FROM l),
reach(v, u) AS (SELECT a, b FROM e UNION SELECT reach.v, e.b FROM reach JOIN e ON e.a = reach.u),
g AS (SELECT v, min(u) AS group_id FROM reach GROUP BY v),
found AS (SELECT r.record_id, g.group_id FROM r JOIN reg ON reg.s = r.s AND reg.k = r.k JOIN g ON g.v = reg.rep)
"""
QUERIES = {"p5_found": p5_found, "p5_group_sizes": p5_group_sizes}
ORACLES = {
    "p5_found": _GROUPS_SQL + "SELECT record_id, group_id FROM found",
    "p5_group_sizes": _GROUPS_SQL
    + "SELECT n_rows, count(*) AS n_groups FROM (SELECT count(*) AS n_rows FROM found GROUP BY group_id) GROUP BY n_rows",
}
