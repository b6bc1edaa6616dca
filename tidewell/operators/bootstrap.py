"""Stationary bootstrap of given series: blocks of geometric length, as marks that each place draws for itself.

A place starts a new block with probability 1 / length, by a hash of draw and place; the first always does. A block starts anywhere in the series, by
another hash, and goes on around its end. So a draw needs no loop: the last mark so far is a running maximum, the place to read follows from it, and values
come by an equi-join on series and place. Work is rows times draws; a draw of a series is one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.operators import rolling, scan


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of parts put together with colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / 2.0**32


def stationary_places(sizes: DataFrame, draws: int, length: float) -> DataFrame:
    """series, draw, place, source (the place to read), starts: for each draw of each series of sizes (series, n)."""
    each = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    draw, place = F.col("draw"), F.col("place")
    marked = each.withColumn("starts", (place == 0) | (unit(F.lit("mark"), draw, place) < 1.0 / length))
    last = F.max(F.when(F.col("starts"), place)).over(W.partitionBy("series", "draw").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    begin = marked.withColumn("_at", last).withColumn("_from", F.floor(unit(F.lit("from"), draw, F.col("_at")) * F.col("n")))
    return begin.select("series", "draw", "place", ((F.col("_from") + place - F.col("_at")) % F.col("n")).alias("source"), "starts")


def stationary_placebos(calendar: DataFrame, observed: DataFrame, draws: int, length: float) -> DataFrame:
    """series, draw, d, value, starts: placebos of observed (series, d, value) along calendar (series, d).

    A day gets the last value known on the day that it reads (null before the first one); only days that have an observation of their own are kept.
    """
    known = observed.where("value IS NOT NULL").select("series", "d", "value")
    joined = calendar.select("series", "d").join(known.withColumn("own", F.lit(True)), ["series", "d"], "left")
    filled = joined.withColumn("seen", F.last("value", ignorenulls=True).over(W.partitionBy("series").orderBy("d")))
    placed = rolling.numbered(filled, "series", "d", scan.day_blocks()).withColumnRenamed("_place", "place")
    drawn = stationary_places(placed.groupBy("series").agg(F.count("*").alias("n")), draws, length)
    read = drawn.join(placed.select("series", F.col("place").alias("source"), F.col("seen").alias("value")), ["series", "source"])
    kept = placed.where("own").select("series", "place", "d")
    return read.join(kept, ["series", "place"]).select("series", "draw", "place", "d", "value", "starts")
