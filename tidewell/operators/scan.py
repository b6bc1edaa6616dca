"""Recursions along a series as scans over blocks, so that one long series is worked on by many tasks.

A block is a stretch of a series that holds a bounded number of rows (a column that grows with the order: for daily rows a number of days). Rows are
dealt by series and block; what a row needs from before its block comes from a table of one row a block, by an equi-join on series and
block, whose partitions the windows have already made. The table of blocks is worked on the same way, in blocks of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.session import stored

#: Rows of a block at most, and blocks of a block of blocks.
ROWS = 1024


def day_blocks(day: str = "d", rows: int = ROWS) -> Column:
    """Block of a daily row: it holds that many rows at most."""
    return F.floor(F.unix_date(day) / rows).cast("long")


def place_blocks(place: str, rows: int = ROWS) -> Column:
    """Block of a row by its whole-numbered place."""
    return F.floor(F.col(place) / rows).cast("long")


def lagged(df: DataFrame, columns: dict[str, str], by: str, order: str, block: str) -> DataFrame:
    """df with the previous row's values: columns maps their new names to columns."""
    w = W.partitionBy(by, block).orderBy(order)
    names, held = list(columns), F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    ends = df.groupBy(by, block).agg(F.max_by(held, order).alias("_last"))
    ends = ends.select(by, block, F.lag("_last").over(W.partitionBy(by).orderBy(block)).alias("_before"))
    inner = df.withColumns({"_own": F.lag(held).over(w), "_first": F.row_number().over(w) == 1})
    out = inner.join(ends, [by, block], "left").withColumn("_was", F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_own")))
    return out.withColumns({n: F.col("_was").getField(n) for n in names}).drop("_own", "_first", "_before", "_was")


def composed(df: DataFrame, by: list[str], order: str, rows: int) -> DataFrame:
    """df with _a and _b: the maps x -> a x + b of the rows up to each one, in groups of at most rows rows, composed by doubling steps."""
    w, step = W.partitionBy(*by).orderBy(order), 1
    out = df.withColumns({"_a": F.col("a"), "_b": F.col("b")})
    while step < rows:
        before_a, before_b = F.lag("_a", step, 1.0).over(w), F.lag("_b", step, 0.0).over(w)
        out = out.withColumns({"_a": F.col("_a") * before_a, "_b": F.col("_a") * before_b + F.col("_b")})
        step *= 2
    return out


def affine(df: DataFrame, by: str, order: str, block: str, to: str = "x", rows: int = ROWS, blocks: int | None = None) -> DataFrame:
    """df (with a and b, not null) with the values x[i] = a[i] x[i-1] + b[i] of each by in order; x before the first row is 0.

    rows: the most rows of a block; blocks: the most blocks of a by, from which on blocks are dealt to blocks again (unknown: counted).
    """
    inner = composed(df, [by, block], order, rows)
    ends = inner.groupBy(by, block).agg(F.max_by(F.struct("_a", "_b"), order).alias("m"))
    ends = ends.select(by, block, F.col("m._a").alias("a"), F.col("m._b").alias("b"))
    if blocks is None:
        least, most = ends.agg(F.min(block), F.max(block)).first()
        blocks = (most - least + 1) if most is not None else 1
    if blocks > ROWS:
        wider = f"{block}_wider"
        carried = affine(stored(ends).withColumn(wider, F.floor(F.col(block) / ROWS).cast("long")), by, block, wider, "_x", ROWS, blocks // ROWS + 2).drop(wider)
    else:
        carried = composed(ends, [by], block, blocks).withColumn("_x", F.col("_b")).drop("_a", "_b")
    before = carried.select(by, block, F.lag("_x", 1, 0.0).over(W.partitionBy(by).orderBy(block)).alias("_before"))
    return inner.join(before, [by, block], "left").withColumn(to, F.col("_a") * F.col("_before") + F.col("_b")).drop("_a", "_b", "_before")
