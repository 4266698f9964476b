"""Queries of problem 3 with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinloom.llm.survivor import DUMMY_PHONES, consensus_contacts, surviving_contacts
from kinloom.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surviving_contacts(table(spark, sf_dir, "ccd_master"))


def p3_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus_contacts(table(spark, sf_dir, "ccd_master"))


_DUMMIES = ", ".join(f"'{d}'" for d in DUMMY_PHONES)
QUERIES = {"p3_found": p3_found, "p3_consensus": p3_consensus}
ORACLES = {
    "p3_found": rf"""
WITH m AS (
  SELECT source, ccd_source_key, record_id, modified, coalesce(id_checked = 1, false) AS checked,
         regexp_extract(regexp_replace(trim(phone_num), '[\s()+.\-]', '', 'g'), '^(?:(?:00)?852)?(\d{{8}})$', 1) AS ph,
         regexp_matches(trim(email), '^[^@]+@[^@]*\.[^@]*$') AS em,
         left(trim(birthday), 10) AS b
  FROM ccd_master WHERE source IS NOT NULL AND ccd_source_key IS NOT NULL
),
d AS (
  SELECT *, CASE
      WHEN regexp_full_match(b, '\d{{4}}-\d{{1,2}}-\d{{1,2}}') THEN try_strptime(b, '%Y-%m-%d')
      WHEN regexp_full_match(b, '\d{{4}}/\d{{1,2}}/\d{{1,2}}') THEN try_strptime(b, '%Y/%m/%d')
      WHEN regexp_full_match(b, '\d{{1,2}}/\d{{1,2}}/\d{{4}}') THEN try_strptime(b, '%d/%m/%Y')
      WHEN regexp_full_match(b, '\d{{1,2}}-\d{{1,2}}-\d{{4}}') THEN try_strptime(b, '%d-%m-%Y')
      WHEN regexp_full_match(b, '\d{{8}}') THEN try_strptime(b, '%Y%m%d') END AS bd
  FROM m
),
u AS (
  SELECT source, ccd_source_key, record_id, modified, checked,
         ph <> '' AND ph NOT IN ({_DUMMIES}) AND length(replace(ph, left(ph, 1), '')) > 0 AS ph_ok,
         coalesce(em, false) AS em_ok,
         coalesce(bd >= TIMESTAMP '1930-01-01' AND bd <= modified, false) AS bd_ok
  FROM d
)
SELECT source, ccd_source_key,
       coalesce(arg_max(record_id, (modified, record_id)) FILTER (WHERE ph_ok), '') AS phone_from,
       coalesce(arg_max(record_id, (modified, record_id)) FILTER (WHERE em_ok), '') AS email_from,
       coalesce(arg_max(record_id, (checked, modified, record_id)) FILTER (WHERE bd_ok), '') AS birthday_from
FROM u GROUP BY source, ccd_source_key HAVING count(*) > 1
"""
}
