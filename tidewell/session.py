"""Helpers on the Spark session."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Batch tables that a context has written, by its application.
_TABLES: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where it is unset one is set in local mode (tests); a cluster must name its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "/tmp/tidewell-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path under the shared folder, among those of this application."""
    return f"{shared_dir(spark)}/tidewell/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stored(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = spark or df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remember_table(spark: SparkSession, name: str) -> None:
    """A table that release() drops."""
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(name)


def release(spark: SparkSession) -> None:
    """Delete what this application has stored and drop its batch tables. Results that still read them must have been written before."""
    for name in _TABLES.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidewell/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound the Arrow batches that go to Python by bytes, so that long texts don't meet in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    ship(spark)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each context: their Python need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_tidewell_shipped", False):
        return
    here = Path(__file__).resolve().parent
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp()), "tidewell_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    context.addPyFile(archive)
    context._tidewell_shipped = True
