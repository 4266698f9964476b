"""Written intermediate tables: they cut lineage and survive the loss of executors.

``spark.checkpoint.dir`` names the folder all executors share.  Only where it is
unset (tests on one machine) a temporary folder is used.  Tables are removed when
the driver exits, or earlier through :meth:`Stage.drop`.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: list[tuple[SparkSession, str]] = []
#: Spark's own setting by which the shuffle files of an execution go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the session; set to a local one only where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='kinloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _FOLDERS:
        try:
            _remove(spark, path)
        except Exception:  # the JVM may be gone already
            pass


class Stage:
    """A scratch area of one operator run; tables in it can be dropped once superseded."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/kinloom-{name}-{uuid.uuid4().hex}"
        self._count = 0
        _FOLDERS.append((spark, self.root))

    def write(self, df: DataFrame, *, partition_by: str | None = None, compression: str = "zstd") -> DataFrame:
        """Materialise ``df`` and return it as a scan of the written table.

        The shuffle files behind it are of no further use and go with the execution.
        """
        self._count += 1
        path = f"{self.root}/{self._count}"
        writer = df.write.option("compression", compression)
        if partition_by:
            writer = writer.partitionBy(partition_by)
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            writer.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kinloom_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Remove a table that no later plan reads."""
        path = getattr(df, "_kinloom_path", None)
        if path:
            _remove(self.spark, path)

    def close(self) -> None:
        """Remove all tables of the area."""
        _remove(self.spark, self.root)
