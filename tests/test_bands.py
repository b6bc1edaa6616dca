import datetime as dt

import numpy as np

from tidewell.operators import bands as B


def plain(close, start):
    """The three models of one series, day by day, from what each day may know."""
    n, H = len(close), B.AHEAD
    x = np.diff(np.log(close), prepend=np.nan)
    vol = np.array([x[i - 29 : i + 1].std(ddof=1) * np.sqrt(365) if i >= 30 else np.nan for i in range(n)])
    amp = np.array([close[i : i + H + 1].max() / close[i : i + H + 1].min() - 1 if i + H < n else np.nan for i in range(n)])
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.log1p(amp) / (vol * np.sqrt(H / 365))
    ok, out = np.isfinite(r), {}
    for t in np.flatnonzero(ok):
        o = [i for i in range(t - H + 1) if ok[i]]
        if t < start:
            continue
        if not o:
            out[t] = None
            continue
        cuts = np.quantile(vol[o], B.QUARTERS)
        g = np.searchsorted(cuts, vol[o], side="right") == np.searchsorted(cuts, vol[t], side="right")
        s = vol[t] * np.sqrt(H / 365)
        order = np.argsort(r[o], kind="stable")
        w = (0.5 ** ((t - np.array(o)) / B.HALF_LIFE))[order]
        c = [np.interp(q, np.cumsum(w) / w.sum(), r[o][order]) for q in B.SHARES]
        a = np.quantile(amp[o][g], B.SHARES).tolist() if g.any() else [None, None]
        out[t] = [*a, *np.expm1(np.quantile(r[o], B.SHARES) * s), *np.expm1(np.array(c) * s)]
    return out


def test_bands_equal_the_plain_models(spark, monkeypatch):
    monkeypatch.setattr(B, "ROWS", 70)
    rng = np.random.default_rng(8)
    start = dt.date(2015, 1, 1)
    prices = {"s": np.round(100 * np.exp(np.cumsum(rng.normal(0, 0.03, 320))), 1), "flat": np.concatenate([np.full(60, 5.0), 5 + rng.random(80)]), "short": np.arange(1.0, 50.0)}
    rows = [(name, start + dt.timedelta(2 * i), float(c)) for name, p in prices.items() for i, c in enumerate(p)]
    df = spark.createDataFrame(rows, "series string, d date, close double")
    first = 60
    got = {(r["series"], (r["d"] - start).days // 2): r for r in B.bands(B.known_ranges(df), str(start + dt.timedelta(2 * first))).collect()}
    want = {(name, t): v for name, p in prices.items() for t, v in plain(p, first).items()}
    assert got.keys() == want.keys() and len(want) > 250
    for k, v in want.items():
        mine = [got[k][c] for c in ("a75", "a95", "b75", "b95", "c75", "c95")]
        assert [x is None for x in mine] == [x is None for x in (v or [None] * 6)]
        assert all(abs(x - y) < 1e-9 for x, y in zip(mine, v or []) if y is not None)
    assert B.bands(B.known_ranges(df.where("false")), "2015-01-01").collect() == []


def test_sums_over_ranks():
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 17, 64):
        t, w = B.Sums(n), np.zeros(n)
        for _ in range(40):
            i, x = int(rng.integers(n)), float(rng.integers(1, 5))
            t.add(i, x)
            w[i] += x
            target = float(rng.integers(1, int(w.sum()) + 1))
            assert t.reach(target) == int(np.argmax(np.cumsum(w) >= target)) and t.below(i) == w[:i].sum()
