import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import levels, scan, wilder


def recursion(rows):
    """rows: (series, i, a, b)."""
    out, x = {}, {}
    for s, i, a, b in sorted(rows):
        x[s] = a * x.get(s, 0.0) + b
        out[s, i] = x[s]
    return out


@pytest.mark.parametrize(("size", "few"), [(8, 1024), (8, 3)])
def test_affine_scan_equals_the_recursion(spark, monkeypatch, size, few):
    monkeypatch.setattr(scan, "ROWS", few)  # few: blocks of blocks of blocks
    rng = np.random.default_rng(4)
    rows = [(s, int(i), float(a), float(b)) for s, n in (("one", 300), ("two", 1), ("gaps", 90)) for i, a, b in zip(np.sort(rng.choice(400, n, replace=False)), rng.uniform(-1, 1, n) * (rng.random(n) > 0.1), rng.normal(size=n))]
    df = spark.createDataFrame(rows, "series string, i long, a double, b double").withColumn("block", scan.place_blocks("i", size))
    got = {(r["series"], r["i"]): r["x"] for r in scan.affine(df, "series", "i", "block", rows=size).collect()}
    want = recursion(rows)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    lag = {(r["series"], r["i"]): r["p"] for r in scan.lagged(df, {"p": "i"}, "series", "i", "block").collect()}
    for s in ("one", "two", "gaps"):
        places = sorted(i for t, i in want if t == s)
        assert [lag[s, i] for i in places] == [None, *places[:-1]]
    assert scan.affine(df.where("false"), "series", "i", "block").collect() == []


def wilder_rows(high, low, close, k):
    tr = [max(h - l, *([abs(h - c), abs(l - c)] if c is not None else [0])) for h, l, c in zip(high, low, [None, *close])]
    out, x = [], None
    for i, t in enumerate(tr):
        x = sum(tr[:k]) / k if i == k - 1 else (x * (k - 1) + t) / k if i >= k else None
        out.append(x)
    return out


def test_wilder_over_blocks(spark):
    rng = np.random.default_rng(5)
    n = 2500
    close = 100 + np.cumsum(rng.normal(size=n))
    high, low = close + rng.random(n), close - rng.random(n)
    start = dt.date(2010, 1, 3)
    rows = [("long", start + dt.timedelta(int(i)), float(h), float(l), float(c)) for i, h, l, c in zip(range(n), high, low, close)]
    rows += [("short", start + dt.timedelta(i), 2.0, 1.0, 1.5) for i in range(13)] + [("just", start + dt.timedelta(3 * i), 2.0, 1.0, 1.5) for i in range(14)]
    df = spark.createDataFrame(rows, "series string, d date, high double, low double, close double")
    got = wilder.atr(df).orderBy("series", "d").collect()
    assert sorted(got[0].asDict()) == ["atr", "close", "d", "high", "low", "series"]
    for name in ("long", "short", "just"):
        own = [r for r in rows if r[0] == name]
        want = wilder_rows([r[2] for r in own], [r[3] for r in own], [r[4] for r in own], 14)
        mine = [r["atr"] for r in got if r["series"] == name]
        assert [x is None for x in mine] == [x is None for x in want]
        assert all(abs(x - y) < 1e-9 for x, y in zip(mine, want) if y is not None)


def test_one_series_is_dealt_to_many_tasks(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("one").alias("series"), F.col("id").alias("i"), (F.col("id") % 97 + 2.0).alias("high"), (F.col("id") % 89 * 1.0 - 90).alias("low"), (F.col("id") % 13 * 1.0).alias("close"))
    found = wilder.atr(df, order="i", block=scan.place_blocks("i")).withColumn("part", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would put so few bytes together
    try:
        sums = found.groupBy("part").agg(F.count("*").alias("n"), F.sum("atr").alias("s")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sums) >= 4 and max(r["n"] for r in sums) < 0.6 * n and sum(r["n"] for r in sums) == n
    i = np.arange(n)
    x = wilder_rows((i % 97 + 2.0).tolist(), (i % 89 - 90.0).tolist(), (i % 13 * 1.0).tolist(), 14)
    assert abs(sum(r["s"] for r in sums) / sum(v for v in x if v is not None) - 1) < 1e-9


def test_zones_of_many_pivots(spark):
    rng = np.random.default_rng(6)
    prices = sorted(float(p) for p in [*rng.uniform(0, 3000, 300), *rng.uniform(5000, 5010, 50), *rng.uniform(9000, 30000, 60)])
    zone, low, last, want = 0, None, None, []
    for p in prices:
        if last is None or p - last > 150 or p - low > 400:
            zone, low = zone + 1, p
        last = p
        want.append((zone, p))
    df = spark.createDataFrame([("s", dt.date(2020, 1, 1) + dt.timedelta(i), "high" if i % 3 else "low", p) for i, p in enumerate(prices)], "series string, d date, kind string, price double")
    got = sorted((r["zone"], r["low"], r["high"], r["touches"]) for r in levels.zones(df, 150.0, 400.0).collect())
    assert got == sorted((z, min(p for y, p in want if y == z), max(p for y, p in want if y == z), sum(y == z for y, _ in want)) for z in {z for z, _ in want})
