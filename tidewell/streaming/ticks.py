"""Structured Streaming over ticks (series, ts, value): windowed sums, episodes as sessions, upserts of the latest day.

State is bounded by watermarks; sinks are idempotent, so a batch that runs twice leaves the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.sources import versions


def ticks(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed(stream: DataFrame, length: str = "8 hours", late: str = "1 day") -> DataFrame:
    """series, start, total, n of tumbling windows; rows later than late behind the newest are left out."""
    sums = stream.withWatermark("ts", late).groupBy("series", F.window("ts", length)).agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    return sums.select("series", F.col("window.start").alias("start"), "total", "n")


def sessions(stream: DataFrame, gap: str = "30 days", late: str = "1 day") -> DataFrame:
    """series, a, z, n of episodes: ticks at most gap apart."""
    found = stream.withWatermark("ts", late).groupBy("series", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.max("ts").alias("z"))
    return found.select("series", F.col("session_window.start").alias("a"), "z", "n")


def upserting(stream: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest row of each key in the versions at path, a micro-batch at a time, until what there is has been read.

    A row that is older than the key's row at path changes nothing; a batch that runs again neither.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), "ts").alias("r")).select(key, "r.*")
        if versions.versions(spark, path):
            had = versions.read(spark, path).select(F.col(key), F.col("ts").alias("had"))
            newest = newest.join(had, key, "left").where("had IS NULL OR ts >= had").drop("had")
        versions.upsert(spark, path, newest, key, (checkpoint, number))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gathered(counts: DataFrame, path: str, key: list[str], checkpoint: str) -> StreamingQuery:
    """Keep an aggregate's latest rows by key in the versions at path, until what there is has been read."""

    def merge(batch: DataFrame, number: int) -> None:
        versions.upsert(batch.sparkSession, path, batch, key, (checkpoint, number))

    return counts.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Finished rows as Parquet at path; the checkpoint remembers which input files have been read."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
