"""Exact quantiles of moving windows by order statistics kept up to date, in blocks with halos.

A window is a span of a whole-numbered key (a day's number, or a row's place in its series). Rows are dealt by series and block of keys, each also to the
later blocks whose windows reach it: with blocks no shorter than the longest window that is two copies of a row at most. A task slides
over its block with a skip list (pandas' rolling quantile), which takes and drops one value in logarithmic time: no window is sorted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pandas.api.indexers import BaseIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators import scan
from tidewell.session import ship


class _Between(BaseIndexer):
    """Windows whose bounds, which never fall, are given."""

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        return self.starts, self.ends


def slid(key: np.ndarray, values: np.ndarray, far: int, near: int, shares: list[float], least: int) -> list[np.ndarray]:
    """For each place of the rising keys the quantiles of the values whose keys lie between key - far and key - near; NaN under least of them."""
    starts, ends = np.searchsorted(key, key - far, "left"), np.searchsorted(key, key - near, "right")
    windows = pd.Series(values).rolling(_Between(starts=starts, ends=np.maximum(starts, ends)), min_periods=least)
    return [windows.quantile(q).to_numpy() for q in shares]


def numbered(df: DataFrame, by: str, order: str, block: Column, to: str = "_place") -> DataFrame:
    """df with each row's place in its series (from 0), without a window over the whole series."""
    blocked = df.withColumn("_block", block)
    own = F.row_number().over(W.partitionBy(by, "_block").orderBy(order))
    n = blocked.groupBy(by, "_block").agg(F.count("*").alias("_n"))
    before = n.select(by, "_block", (F.sum("_n").over(W.partitionBy(by).orderBy("_block")) - F.col("_n")).alias("_before"))
    return blocked.withColumn("_own", own).join(before, [by, "_block"]).withColumn(to, F.col("_before") + F.col("_own") - 1).drop("_block", "_own", "_before")


def quantiles_by_key(df: DataFrame, x: str, shares: dict[str, float], key: Column, far: int, near: int, by: str = "series", least: int = 1) -> DataFrame:
    """df with a column for each of shares (name: q): the quantile of the non-null x of its series whose key is far to near behind the row's.

    Null under least values. A column with one of these names is replaced; rows without a key have nulls and stand in no window.
    """
    ship(df.sparkSession)
    own, long = df.drop(*shares), max(scan.ROWS, far)
    reach = F.sequence(F.floor(F.col("_key") / long), F.floor((F.col("_key") + far) / long))
    dealt = own.withColumn("_key", key.cast("long")).withColumn("_part", F.explode(F.when(F.col("_key").isNull(), F.array(F.lit(None).cast("long"))).otherwise(reach)))
    kept, names, wanted = own.columns, [*shares], [*shares.values()]
    schema = T.StructType([*own.schema.fields, *[T.StructField(n, T.DoubleType()) for n in shares]])

    def work(t: pa.Table) -> pa.Table:
        t = t.sort_by("_key")
        if t["_key"].null_count:
            mine, found = np.ones(t.num_rows, bool), [np.full(t.num_rows, np.nan)] * len(names)
        else:
            keys = t["_key"].to_numpy()
            mine = keys // long == t["_part"][0].as_py()
            found = slid(keys, t[x].to_numpy(zero_copy_only=False).astype(float), far, near, wanted, least)
        out = t.select(kept).filter(pa.array(mine))
        for name, q in zip(names, found, strict=True):
            out = out.append_column(name, pa.array(q[mine], pa.float64(), from_pandas=True))
        return out

    return dealt.groupBy(by, "_part").applyInArrow(work, schema)


def quantiles_of_days(df: DataFrame, x: str, shares: dict[str, float], days: int, by: str = "series", day: str = "d") -> DataFrame:
    """Quantiles of the values dated 1 to days days before."""
    return quantiles_by_key(df, x, shares, F.unix_date(day), days, 1, by)


def quantiles_of_rows(df: DataFrame, x: str, shares: dict[str, float], k: int, lag: int = 0, by: str = "series", order: str = "d", block: Column | None = None) -> DataFrame:
    """Quantiles of the k rows that end lag rows before; null unless they hold k values. block: see scan (default: stretches of days)."""
    placed = numbered(df, by, order, scan.day_blocks(order) if block is None else block)
    return quantiles_by_key(placed, x, shares, F.col("_place"), k - 1 + lag, lag, by, k).drop("_place")
