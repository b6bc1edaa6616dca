import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import topk


def brute(rows, k):
    """rows: (vec_id, list): the contract in plain Python."""
    good = {(i, tuple(int(np.floor(1024.0 * x)) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in {i for i, _ in good if i % 100 == 0}:
        best = {}
        for i, a in good:
            for j, b in good:
                if i == q and j != q and len(a) == len(b):
                    s = min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1)
                    best[j] = max(best.get(j, s), s)
        out += [(q, r + 1, j, s) for r, (j, s) in enumerate(sorted(best.items(), key=lambda t: (-t[1], t[0]))[:k])]
    return sorted(out)


def run(spark, rows, k=10, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = topk.top_k(df.withColumn("rank", F.lit("x")).withColumn("query_id", F.lit(1)), F.col("vec_id") % 100 == 0, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "PART", 70)
    monkeypatch.setattr(topk, "GROUP", 2)
    monkeypatch.setattr(topk, "SAMPLE", 40)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(8, 6))
    rows = [(int(i), [float(np.float32(x)) for x in base[i % 8] + 0.1 * rng.normal(size=6)]) for i in range(260)]
    rows += [(1000 + i, rows[100][1]) for i in range(60)]  # equal vectors: ties
    rows += [rows[3], rows[3], (100, rows[7][1]), (17, rows[9][1])]  # repeated rows, ids with two vectors
    rows += [(5000, None), (5100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (5200, [float("nan")] * 6), (5300, [float("inf")] * 6), (None, rows[0][1]), (5400, []), (5500, [1.0, 2.0]), (5501, [3.0, -1.0])]
    want = brute(rows, 10)
    assert run(spark, rows) == want
    monkeypatch.setattr(topk, "ROUND_BYTES", 200)  # several rounds
    assert run(spark, rows) == want


def test_few_rows_and_large_components(spark):
    assert run(spark, []) == []
    assert run(spark, [(100, [1.0])]) == []
    rows = [(100, [3e30, 1.0]), (1, [2.0, 5.0]), (2, [1e30, -1e30])]
    assert run(spark, rows) == brute(rows, 10)


def test_tree_covers_its_points():
    x = np.random.default_rng(0).normal(size=(500, 16))
    t = topk.CoverTree(x)
    for n, own in enumerate(t.points):
        assert (np.sqrt(((x[own] - x[t.center[n]]) ** 2).sum(1)) <= t.radius[n] + 1e-9).all()
        if t.children[n]:
            assert sorted(i for c in t.children[n] for i in t.points[c]) == sorted(own)
    assert topk.CoverTree(np.ones((300, 4))).children == [[]]


def test_wide_doubles(spark):
    rows = [(100, [1.0, 2.0]), (1, [2.0, 5.0]), (2, [1e306, 1.0]), (3, [3.0, 1.0])]  # 1024 * 1e306 is no double
    assert run(spark, rows, kind="double") == brute([r for r in rows if r[0] != 2], 10)
    rng = np.random.default_rng(5)
    rows = [(10 * i, [float(x) for x in rng.normal(size=3) * 10.0 ** rng.integers(0, 160)]) for i in range(120)]
    assert run(spark, rows, kind="double") == brute(rows, 10)
