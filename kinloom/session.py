"""Session settings used by tests and the bench (a cluster brings its own)."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers of every executor, once per application.

    Functions that run in workers are found by name there, so a session that was
    started without the package on the workers' path can use them too.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="kinloom-")) / f"{here.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(here.rglob("*.py")):
            z.write(file, file.relative_to(here.parent))
    context.addPyFile(str(archive))  # the driver serves it to the executors
    _SHIPPED.add(context.applicationId)


def local_session(cpus: int | str = "*", *, partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A local session: UTC, AQE with skew handling, Arrow, no UI."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("kinloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
