import pytest
from pyspark.sql import functions as F

from tidewell.llm import mixing


def test_targets_are_reshared():
    # 5 : 2 : 1 of 150; the first stops at 2 * 20, the rest goes to the others by 2 : 1
    got = mixing.reshared_targets([20, 50, 30], [5, 2, 1], 1.5, 2)
    assert got == pytest.approx([40, 220 / 3, 110 / 3])
    assert mixing.reshared_targets([0, 0], [5, 2], 1.5, 2) == [0.0, 0.0]
    assert mixing.reshared_targets([], [], 1.5, 2) == []
    got = mixing.reshared_targets([10, 10, 1000], [5, 2, 1], 1.5, 2)
    assert got[:2] == [20, 20] and sum(got) == pytest.approx(1530)


def brute_cost(capacity, taken):
    return sum(sum(min(max(t - k * c, 0), c) * (k + 1) ** 2 for k in range(3)) for p, c in capacity.items() for t in [taken.get(p, 0)])


def test_flow_of_overlapping_sources():
    capacity = {("a",): 10, ("a", "b"): 10, ("b",): 10}
    taken = mixing.route(capacity, {"a": 15, "b": 15}, 2)
    assert sum(taken.values()) == pytest.approx(30)
    assert all(taken[p] == pytest.approx(10) for p in capacity)  # nothing twice
    taken = mixing.route(capacity, {"a": 30, "b": 20}, 2)
    assert sum(taken.values()) == pytest.approx(50)
    assert brute_cost(capacity, taken) == pytest.approx(30 * 1 + 20 * 4)
    taken = mixing.route({("a",): 5, ("b",): 0}, {"a": 100, "b": 7}, 2)
    assert taken[("a",)] == 10


def brute_flow(capacity, quota, most):
    """Cheapest total cost by trying every routing of whole words."""
    import itertools

    arcs = [(p, s) for p in capacity for s in p]
    best = None
    for x in itertools.product(*[range(most * capacity[p] + 1) for p, _ in arcs]):
        took = {}
        for (p, s), n in zip(arcs, x):
            took[p] = took.get(p, 0) + n
        if any(took[p] > most * capacity[p] for p in took):
            continue
        got = {s: sum(n for (_, t), n in zip(arcs, x) if t == s) for s in quota}
        if any(got[s] > quota[s] for s in quota):
            continue
        key = (-sum(got.values()), brute_cost(capacity, took))
        best = key if best is None or key < best else best
    return best


def test_flow_is_cheapest():
    for capacity, quota in [({("a",): 2, ("a", "b"): 2, ("b",): 1}, {"a": 5, "b": 3}), ({("a", "b"): 2, ("b",): 3}, {"a": 2, "b": 5}), ({("a", "b"): 3, ("a",): 1}, {"a": 1, "b": 6})]:
        taken = mixing.route(capacity, quota, 2)
        assert (-sum(taken.values()), brute_cost(capacity, taken)) == pytest.approx(brute_flow(capacity, quota, 2))


def test_contract(spark):
    rows = [(i, "w " * (i % 37 + 1), f"s{i % 5}" if i % 11 else None) for i in range(600)] + [(3, None, "s0"), (4, "", "s1"), (7, "a b", "s2"), (7, "a b", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(docs)
    assert got.count() == len(rows)
    per = got.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.sum("size").alias("s"), F.max("source_size").alias("m")).collect()
    assert all(r["s"] == r["m"] and abs(r["t"] - r["g"]) <= 2 for r in per)
    assert sum(r["g"] for r in per) == pytest.approx(1.5 * sum(r["s"] for r in per))
    assert got.where("taken > 2 * size or taken < 0 or (size > 0 and taken % size != 0)").count() == 0
    assert sorted(map(str, got.collect())) == sorted(map(str, mixing.mixed(docs).collect()))
    assert mixing.mixed(docs.limit(0)).count() == 0


def brute_taken(units, words):
    """units: (unit, size, h). The units that the seeded order takes to come near words: whole bins, first fit in the last, then the one that comes nearest."""
    bins = lambda h: ((h % 2**64) >> 52, ((h % 2**64) >> 40) % mixing.BINS)
    left, cut = words, None
    for level in (0, 1):
        level_units = [u for u in units if level == 0 or bins(u[2])[0] == cut]
        sums = {}
        for u in level_units:
            sums[bins(u[2])[level]] = sums.get(bins(u[2])[level], 0) + u[1]
        at, before = None, 0
        for b in sorted(sums):
            if before <= left:
                at, base = b, before
            before += sums[b]
        left -= base
        if level == 0:
            cut = at
    second = at
    taken = {u[0] for u in units if bins(u[2]) < (cut, second)}
    for unit, size, h in sorted([u for u in units if bins(u[2]) == (cut, second)], key=lambda u: (u[2], u[0])):
        if size <= left:
            taken.add(unit)
            left -= size
    missing = words - sum(u[1] for u in units if u[0] in taken)
    rest = [(abs(size - missing), h, unit) for unit, size, h in units if unit not in taken and abs(size - missing) < missing]
    return taken | ({min(rest)[2]} if rest else set())


def test_taken_against_brute_force(spark):
    rows = [(i, "w " * (i * 7 % 53 + 1), ["a", "b", None][i % 7 % 3]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["source"], r["size"], r["target"], r["taken"]) for r in mixing.mixed(docs).collect()}
    for source in ("a", "b", None):
        own = {i: x for i, x in got.items() if x[0] == source}
        words, target = sum(x[1] for x in own.values()), next(iter(own.values()))[2]
        pattern = '["n"]' if source is None else f'["s{source}"]'
        keys = spark.createDataFrame([(f"{i}|{x[1]}", x[1]) for i, x in own.items()], "unit string, size long")
        units = [tuple(r) for r in keys.select("unit", "size", F.xxhash64(F.lit(pattern), "unit", F.lit(17))).collect()]
        rounds = min(2, int(target // words))
        more = brute_taken(units, target - rounds * words) if target > rounds * words else set()
        assert {i: x[3] for i, x in own.items()} == {i: x[1] * (rounds + (f"{i}|{x[1]}" in more)) for i, x in own.items()}


def test_targets_over_ranges_are_those_of_the_list(spark):
    sizes = {f"s{i:03d}": (i * i * 37) % 900 for i in range(70)} | {None: 5}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long"), parts=5).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = mixing.reshared_targets([sizes[s] for s in order], [mixing.WEIGHTS[i % 3] for i in range(len(order))], 1.5, 2)
    assert [got[s] for s in order] == pytest.approx(want)


def test_overlapping_sources_through_spark(spark):
    capacity = {("a",): 10, ("a", "b"): 10, ("b",): 10, ("c",): 4, ("d", "e"): 6}
    quota = {"a": 30.0, "b": 20.0, "c": 100.0, "d": 1.0, "e": 2.0}
    rows = [("/".join(p), list(p), n) for p, n in capacity.items()]
    got = mixing.flows(spark.createDataFrame(rows, "pattern string, sources array<string>, words long"), spark.createDataFrame(list(quota.items()), "source string, quota double"), 2)
    taken = {r["pattern"]: r["rounds"] * capacity[tuple(r["pattern"].split("/"))] + r["words"] for r in got.collect()}
    assert taken == pytest.approx({"/".join(p): n for p, n in mixing.route(capacity, quota, 2).items()} | {k: v for k, v in taken.items() if not v})
    assert sum(taken[p] for p in ("a", "a/b", "b")) == pytest.approx(50) and taken["c"] == 8 and taken["d/e"] == pytest.approx(3)
