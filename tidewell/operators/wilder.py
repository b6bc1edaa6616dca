"""Wilder's average true range: a recursion along a series, as a scan of affine maps over blocks of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.operators import scan


def atr(bars: DataFrame, k: int = 14, order: str = "d", block: Column | None = None) -> DataFrame:
    """bars with atr: the mean of the first k true ranges, then (previous * (k - 1) + true range) / k.

    Null true ranges count as 0; a series of fewer rows has none. block: see scan (default: stretches of days). Only the first k rows of a series
    meet in one task, behind a limit that Spark applies before its shuffle.
    """
    blocked = bars.withColumn("_block", scan.day_blocks(order) if block is None else block)
    ranged = scan.lagged(blocked, {"_close": "close"}, "series", order, "_block")
    high, low, previous = F.col("high"), F.col("low"), F.col("_close")
    ranged = ranged.withColumn("_tr", F.coalesce(F.greatest(high - low, F.abs(high - previous), F.abs(low - previous)), F.lit(0.0))).drop("_close")
    at = F.row_number().over(W.partitionBy("series").orderBy(order))
    first = ranged.select("series", order, "_tr").withColumn("_i", at).where(F.col("_i") <= k)
    seed = first.groupBy("series").agg(F.avg("_tr").alias("_seed"), F.max(order).alias("_from"), F.count("*").alias("_n")).where(F.col("_n") == k).drop("_n")
    joined = ranged.join(seed, "series", "left")
    later, now = F.col(order) > F.col("_from"), F.col(order) == F.col("_from")
    maps = joined.withColumns({"a": F.when(later, (k - 1) / k).otherwise(0.0), "b": F.when(later, F.col("_tr") / k).when(now, F.col("_seed")).otherwise(0.0)})
    found = scan.affine(maps, "series", order, "_block", "_x")
    return found.withColumn("atr", F.when(F.col(order) >= F.col("_from"), F.col("_x"))).drop("_block", "_tr", "_seed", "_from", "_x", "a", "b")


def weekly_on_daily(daily: DataFrame) -> DataFrame:
    """series, d, atr with is_week_close and weekly_atr: on a week's last day its own value, on the others that of the week before."""
    week = F.date_add(F.date_trunc("week", "d").cast("date"), 6)
    x = daily.withColumn("week", week)
    weeks = x.where("atr IS NOT NULL").groupBy("series", "week").agg(F.max_by("atr", "d").alias("own"), F.max("d").alias("last"))
    weeks = weeks.withColumn("previous", F.lag("own").over(W.partitionBy("series").orderBy("week")))
    joined = x.join(weeks, ["series", "week"], "left").withColumn("is_week_close", F.col("d") == F.col("last"))
    return joined.withColumn("weekly_atr", F.when(F.col("is_week_close"), F.col("own")).otherwise(F.col("previous")))
