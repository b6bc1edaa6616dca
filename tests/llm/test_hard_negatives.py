import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import hard_negatives as H


def brute(rows, scale=256.0, positives=5, negatives=3):
    """rows: (vec_id, list, label): the contract in plain Python integers; anchors are ids divisible by 50."""
    good = {}
    for i, v, label in rows:
        if i is not None and v and label is not None and all(x is not None and np.isfinite(x) and np.isfinite(scale * x) for x in v):
            row = (label, tuple(v))
            good[i] = min(good.get(i, row), row)
    ints = {i: (label, [int(np.floor(scale * x)) for x in v]) for i, (label, v) in good.items()}
    out = []
    for a, (label, q) in ints.items():
        if a % 50:
            continue
        s = [(-min(max(sum(x * y for x, y in zip(q, v)), H.LEAST), H.MOST), i, other) for i, (other, v) in ints.items() if i != a and len(v) == len(q)]
        s.sort()
        for p, pid, _ in [x for x in s if x[2] == label][:positives]:
            fits = [(-n, nid) for n, nid, other in s if other != label and 50 * -p <= 100 * -n <= 95 * -p]
            out += [(a, pid, r + 1, nid, -p, n) for r, (n, nid) in enumerate(fits[:negatives])]
    return sorted(out)


def run(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumns({"anchor_id": F.lit("x"), "rank": F.lit(0), "v": F.lit(1), "q": F.lit("y")})
    got = H.mine(df, F.col("vec_id") % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, d))
    return [(int(i), [float(np.float32(x)) for x in base[rng.integers(6)] + 0.6 * rng.normal(size=d)], int(rng.integers(4)) if i % 3 else 1) for i in range(n)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "PART", 150)
    monkeypatch.setattr(H, "LEAF", 6)
    monkeypatch.setattr(H, "BLOCK", 7)
    rows = vectors(700, 5, 3)
    rows += [(1000 + i, rows[60][1], 1 + i % 2) for i in range(40)]  # equal vectors: ties within a label and across
    rows += [rows[3], rows[3], (100, rows[7][1], 0), (17, rows[9][1], 3), (17, rows[9][1], None)]  # repeated rows and ids
    rows += [(5000, None, 1), (5050, [1.0, None, 0.0, 0.0, 0.0], 1), (5100, [float("nan")] * 5, 1), (5150, [float("inf")] * 5, 2), (None, rows[0][1], 1), (5200, [], 1), (5250, [1.0, 2.0], 1), (5251, [3.0, 1.0], 1), (5252, [2.0, 1.0], 2), (5300, rows[50][1], None), (5350, rows[50][1], 99)]
    want = brute(rows)
    assert len(want) > 100
    assert run(spark, rows) == want
    monkeypatch.setattr(H, "ROUND_BYTES", 500)  # several rounds
    assert run(spark, rows) == want


def test_wide_components(spark):
    rows = [(50, [3e30, 1.0], 1), (1, [2e30, 5.0], 1), (2, [1e30, -1e30], 2), (3, [-1e160, 2.0], 2), (4, [1e160, 2.0], 1), (100, [1e306, 1.0], 1), (150, [5.0, 1.0], 1), (5, [4.0, 1.0], 1), (6, [3.0, 1.0], 2)]
    assert run(spark, rows, "double") == brute(rows)


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(50, [1.0], 1), (51, [2.0], 2)]) == []  # no positive
    rows = [(50, [1.0], 1), (51, [-2.0], 1), (52, [-1.0], 2), (100, [0.0], 3), (101, [5.0], 3), (102, [7.0], 4)]  # negative and zero scores of positives
    assert run(spark, rows) == brute(rows)


def test_balls_hold_their_rows():
    x = np.floor(100 * np.random.default_rng(0).normal(size=(600, 8)))
    t = H.BallTree(x, np.arange(600)[::-1].copy(), np.arange(600) % 5)
    held = [r for r in t.rows if r is not None]
    assert sorted(np.concatenate(held)) == list(range(600)) and max(map(len, held)) <= H.LEAF
    for c, r, rows in zip(t.center, t.radius, t.rows):
        if rows is not None:
            assert (np.sqrt(((t.x[rows] - c) ** 2).sum(1)) <= r + 1e-6).all()
    assert H.window(101, 50, 95) == (51, 95) and H.window(-100, 50, 95) == (-50, -95)
