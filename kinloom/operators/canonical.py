"""Canonical records: every attribute resolved by the policy and normalised once."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kinloom.functions.characters import pinyin_table
from kinloom.functions.normalize import (
    birthday,
    chinese_compact,
    email,
    english_words,
    identifier,
    initials,
    phone,
)
from kinloom.operators.policy import ALIASES, Policy, global_identifier


def canonical_records(raw: DataFrame, policy: Policy) -> DataFrame:
    """One row per raw row; missing values are null.

    Further columns of ``raw`` do not come through.  A null source takes the
    default columns and never pairs up.
    """
    spark = raw.sparkSession
    resolved = raw.select(
        "record_id",
        F.nullif("source", F.lit("")).alias("source"),
        F.col("modified").alias("source_modified"),
        "ccd_source_key",
        *(policy.value(raw, a).alias(a) for a in ALIASES),
    )
    ids = {a: identifier(F.col(a)) for a in ("hkid", "hksr_num")}
    named = resolved.select(
        "record_id",
        "source",
        "source_modified",
        "ccd_source_key",
        chinese_compact(spark, F.col("chi_surname")).alias("chi_surname"),
        chinese_compact(spark, F.col("chi_firstname")).alias("chi_firstname"),
        english_words(F.col("eng_surname")).alias("eng_surname"),
        english_words(F.col("eng_firstname")).alias("eng_firstname"),
        phone(F.col("phone")).alias("phone"),
        email(F.col("email")).alias("email"),
        birthday(F.col("birthday")).alias("birthday"),
        ids["hksr_num"].alias("hksr_num"),
        ids["hkid"].alias("hkid"),
        global_identifier(policy, ids, F.col("source")).alias("global_id"),
    )
    surname_compact = F.replace("eng_surname", F.lit(" "), F.lit(""))
    return named.select(
        "*",
        F.nullif(F.concat(F.coalesce("chi_surname", F.lit("")), F.coalesce("chi_firstname", F.lit(""))), F.lit("")).alias("chi_full"),
        F.nullif(F.concat_ws(" ", "eng_surname", "eng_firstname"), F.lit("")).alias("eng_full"),
        F.left(F.replace("eng_firstname", F.lit(" "), F.lit("")), F.lit(2)).alias("eng_given_prefix"),
        F.coalesce("chi_surname", surname_compact).alias("surname_key"),
        initials(F.col("eng_firstname")).alias("eng_initials"),
    )


def syllables(spark: SparkSession):
    """Column function of a Chinese text: its syllables parted by spaces, other characters kept."""
    table = spark.sparkContext.broadcast(pinyin_table(spark))  # one entry for each ideograph of the basic block

    def run(values: pa.Array) -> pa.Array:
        own = table.value
        return pa.array([None if v is None else " ".join(own.get(ch, ch) for ch in v) for v in values.to_pylist()], pa.string())

    return F.arrow_udf(run, StringType())


def with_pinyin(records: DataFrame) -> DataFrame:
    """Adds ``chi_surname_pinyin``, ``chi_firstname_pinyin``: syllables parted by spaces, other characters kept."""
    read = syllables(records.sparkSession)
    return records.select("*", read("chi_surname").alias("chi_surname_pinyin"), read("chi_firstname").alias("chi_firstname_pinyin"))
