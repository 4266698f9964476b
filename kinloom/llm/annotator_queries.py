"""Queries of problem 7 with their SQL (the model itself is iterative and has none)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinloom.llm.annotators import agreement, annotator_reliability, latest_answers, pair_consensus
from kinloom.sources.tables import table


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "ccd_match_evaluation_pair"), table(spark, sf_dir, "ccd_match_review_label")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_consensus(*_tables(spark, sf_dir)).select("pair_name", "consensus")


def p7_reviewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotator_reliability(*_tables(spark, sf_dir))


def p7_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement over the pairs that need double review."""
    pairs, labels = _tables(spark, sf_dir)
    double = pairs.filter("needs_double_review = 1").selectExpr("name AS item")
    return agreement(latest_answers(labels).join(double, "item", "left_semi"))


QUERIES = {"p7_found": p7_found, "p7_reviewers": p7_reviewers, "p7_agreement": p7_agreement}
ORACLES = {
    "p7_agreement": """
WITH a AS (
  SELECT parent, reviewer, arg_max(label, (submitted_at, idx, label)) AS answer
  FROM ccd_match_review_label
  WHERE coalesce(is_adjudication, 0) <> 1 AND label IN ('Same', 'Different', 'Unsure') AND parent IS NOT NULL AND reviewer IS NOT NULL
    AND parent IN (SELECT name FROM ccd_match_evaluation_pair WHERE needs_double_review = 1)
  GROUP BY parent, reviewer
),
i AS (
  SELECT parent, count(*) AS m, count(*) FILTER (WHERE answer = 'Same') AS s,
         count(*) FILTER (WHERE answer = 'Different') AS d, count(*) FILTER (WHERE answer = 'Unsure') AS u
  FROM a GROUP BY parent HAVING count(*) >= 2
),
t AS (
  SELECT count(*) AS n_items, sum(m) AS n, sum((m * m - s * s - d * d - u * u) / (m - 1)) AS off,
         sum(s) AS s, sum(d) AS d, sum(u) AS u FROM i
)
SELECT n_items, CAST(n AS BIGINT) AS n_answers, round(1 - off * (n - 1) / (n * n - s * s - d * d - u * u), 6) AS alpha FROM t
"""
}
