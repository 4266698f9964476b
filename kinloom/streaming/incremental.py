"""Incremental matching: files of changed records stream in, their matches are replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.operators.formula_match import match_source


def changed_records(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of the Parquet files that arrive in ``folder``."""
    return spark.readStream.schema(schema).parquet(folder)


def match_changes(changes: DataFrame, master, formulas: dict[str, str], target: str, checkpoint: str):
    """Start a query that matches every micro-batch's changed keys and writes them under ``target/batch=<n>``.

    ``master`` is a function giving the present master table.  A batch that is
    delivered again overwrites its own folder, so a retry changes nothing; readers
    take for each parent the rows of its latest batch (see :func:`current_matches`).
    """

    def run(batch: DataFrame, number: int) -> None:
        keys = batch.select("source", "ccd_source_key").distinct()
        for source, text in sorted(formulas.items()):
            own = keys.filter(F.col("source") == source).select("ccd_source_key")
            processed = master().join(own, "ccd_source_key", "left_semi").filter(F.col("source") == source)
            found = match_source(master(), source, text, changed=own)
            marked = processed.select(F.col("record_id").alias("parent")).distinct().join(found, "parent", "left")
            marked.write.mode("overwrite").parquet(f"{target}/batch={number}/for={source}")

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_matches(spark: SparkSession, target: str) -> DataFrame:
    """The matches of each parent's latest batch; a parent without matches there has none."""
    stored = spark.read.option("basePath", target).parquet(f"{target}/batch=*/for=*")
    latest = stored.groupBy("parent").agg(F.max("batch").alias("batch"))
    return stored.join(latest, ["parent", "batch"]).filter("client IS NOT NULL").drop("batch", "for")
