"""Parquet sources: every table is one directory or file ``<name>.parquet``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table; filters and column selection reach the Parquet reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blank_to_null(df: DataFrame) -> DataFrame:
    """Missing strings are null or ``''`` in the sources; inside the engine they are null."""
    return df.select(
        *(F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes)
    )
