import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidewell.operators import rolling, scan


def series(n, seed, name="s"):
    rng = np.random.default_rng(seed)
    days = np.sort(rng.choice(3 * n, n, replace=False))
    values = np.where(rng.random(n) < 0.05, np.nan, np.round(rng.normal(size=n), 1))
    return [(name, dt.date(2000, 1, 1) + dt.timedelta(int(d)), None if np.isnan(v) else float(v)) for d, v in zip(days, values)]


def same(a, b):
    return (a is None) == (b is None) and (a is None or abs(a - b) < 1e-12)


def test_quantiles_equal_sorted_windows(spark, monkeypatch):
    monkeypatch.setattr(scan, "ROWS", 64)
    rows = series(500, 1) + series(90, 2, "t") + [("empty", dt.date(2001, 1, 1), None)]
    df = spark.createDataFrame(rows, "series string, d date, value double").withColumn("q", F.lit("clash"))
    by_day = {(r["series"], r["d"]): r for r in rolling.quantiles_of_days(df, "value", {"q": 0.8, "low": 0.1}, 100).collect()}
    block = scan.day_blocks("d", 64)
    by_row = {(r["series"], r["d"]): r for r in rolling.quantiles_of_rows(df, "value", {"q": 1 / 3}, 20, 2, block=block).collect()}
    assert len(by_day) == len(by_row) == len(rows)
    for name in ("s", "t", "empty"):
        own = [r for r in rows if r[0] == name]
        for i, (_, d, _) in enumerate(own):
            past = [v for _, e, v in own if 1 <= (d - e).days <= 100 and v is not None]
            for q, share in (("q", 0.8), ("low", 0.1)):
                assert same(by_day[name, d][q], float(np.quantile(past, share)) if past else None)
            window = [v for _, _, v in own[max(i - 21, 0) : max(i - 1, 0)]]
            whole = len(window) == 20 and None not in window
            assert same(by_row[name, d]["q"], float(np.quantile(window, 1 / 3)) if whole else None)
    nothing = rolling.quantiles_of_days(df.where("false"), "value", {"q": 0.5}, 10)
    assert nothing.collect() == [] and nothing.columns == ["series", "d", "value", "q"]


def test_work_grows_with_rows_and_the_logarithm_of_the_window(monkeypatch):
    """Windows of 50 times the rows don't cost 50 times as much, as sorting each of them would."""
    import time

    key, values = np.arange(60_000), np.random.default_rng(0).normal(size=60_000)
    took = []
    for far in (200, 10_000):
        began = time.process_time()
        rolling.slid(key, values, far, 1, [0.8], 1)
        took.append(time.process_time() - began)
    assert took[1] < 10 * max(took[0], 0.05)
