import math

import numpy as np
import pytest

from tidewell.operators import quantile as Q

SHARES = {"low": 0.0, "a": 0.1, "third": 1 / 3, "mid": 0.5, "most": 0.999, "top": 1.0}


def want(rows):
    out = {}
    for k in {r[0] for r in rows}:
        own = [v for g, v in rows if g == k and v is not None and math.isfinite(v)]
        if own:
            out[k] = (len(own), *np.quantile(own, [*SHARES.values()]))
    return out


@pytest.mark.parametrize("sent", [20_000, 0])
def test_equal_to_numpy(spark, monkeypatch, sent):
    monkeypatch.setattr(Q, "SMALL", 3)  # many rounds
    monkeypatch.setattr(Q, "GRID", 6)
    monkeypatch.setattr(Q, "SENT", sent)  # 0: dealt by salts
    rng = np.random.default_rng(3)
    rows = [("hot", float(x)) for x in rng.normal(size=1500)]
    rows += [("ties", float(x)) for x in rng.integers(0, 4, 300)] + [("one value", 7.5)] * 200 + [("wide", float(s * 10.0**e)) for e in range(-300, 300, 9) for s in (-1, 1)]
    rows += [("single", 3.0), (None, 1.0), (None, 2.0), ("nothing", None), ("nothing", float("nan")), ("odd", float("inf")), ("odd", 4.0), ("mostly", 9.0), *[("mostly", 1.0)] * 90]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["n"], *[r[k] for k in SHARES]) for r in Q.quantiles(df, ["g"], "v", SHARES).collect()}
    expected = want(rows)
    assert got.keys() == expected.keys()
    for k in expected:
        assert got[k] == pytest.approx(expected[k], rel=1e-12)


def test_empty(spark):
    assert Q.quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", {"p": 0.5}).collect() == []
