import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from tidewell.llm import fingerprint as fp


def texts_frame(spark, pairs):
    return spark.createDataFrame(pairs, "a string, b string")


def test_likeness_is_that_of_the_digest_sets(spark):
    rng = random.Random(3)
    line = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(5, 60)))
    pairs = []
    for n in (0, 1, 3, 10, 40, 120):
        base = [line() for _ in range(n)]
        for m in (0, 1, 2, 5):
            other = base[:-m] + [line() for _ in range(m)] if m else base
            pairs.append(("\n".join(base), "\n".join(other)))
        pairs.append(("\n".join(base), "\n".join(line() for _ in range(n))))
    df = texts_frame(spark, pairs).withColumns({"x": fp.digests(F.col("a")), "y": fp.digests(F.col("b"))})
    df = df.withColumns({"p": fp.cells(F.col("x")), "q": fp.cells(F.col("y"))})
    rows = df.select("x", "y", fp.likeness(F.col("p"), F.col("q")).alias("s")).collect()
    close = 0
    for r in rows:
        x, y = {*r["x"]}, {*r["y"]}
        want = len(x & y) / len(x | y) if x | y else 1.0
        assert 0 <= r["s"] <= 1
        if want > 0.4 or want == 0:  # peeling gives them all; beyond, a block may count as different
            close += abs(r["s"] - want) < 1e-9
        else:
            close += r["s"] <= want + 1e-9
    assert close >= len(rows) - 1


def test_query_against_plain_python(spark):
    rows = [(5, "ab" * 40 + "\n" + "cd" * 30), (2, "xyz"), (9, None), (7, "héllo wörld\n" * 30), (7, "héllo wörld\n" * 30), (11, ""), (3, "q" * 5000)]
    got = {(r["doc_id"], r["n_chars"]): r for r in fp.compared(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted({(i, t or "") for i, t in rows})
    for k, (i, t) in enumerate(order):
        head = order[(k + 1) % len(order)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + head[:cut]
        assert got[i, len(t)]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert fp.compared(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)
    assert got[11, 0]["near_edited"] == 1.0
    same = spark.createDataFrame([(1, "a\nb" * 9), (2, "a\nb" * 9)], "doc_id long, text string")
    a, b = fp.compared(same).collect()
    assert a["fingerprint"] == b["fingerprint"] and a["near_next"] == 1.0
    assert fp.compared(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = fp.compared(spark.createDataFrame([(None, "only one")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


def test_neighbours_over_ranges(spark):
    ids = spark.range(0, 3000, 3).selectExpr("id as k", "id * 2 as n")
    got = {r["k"]: r["prev"] for r in fp.neighbours(ids, 16).collect()}
    assert got == {k: (k - 3) % 3000 for k in range(0, 3000, 3)}


def test_planted_edit_is_nearer_than_the_next(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    m = fp.compared(docs).where("n_chars > 200").agg(F.avg("near_edited"), F.avg("near_next"), F.avg(F.expr("int(near_edited > near_next)"))).first()
    assert m[0] > 0.4 and m[1] < 0.1 and m[2] > 0.9


def test_texts_on_both_sides_of_a_piece_limit_are_alike(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    pairs = []
    for limit in (128, 1024):
        for n in (limit - 1, limit, limit + 1, limit * 5 // 4):
            text = "".join(word() + " " for _ in range(n))[:n]
            pairs += [(text, text[: n * 4 // 5]), (text[: n * 4 // 5] + "?" * 3, text), (text, text + "\n" + word() * 3)]
    made = texts_frame(spark, pairs).withColumns({"x": fp.tables(F.col("a")), "y": fp.tables(F.col("b"))})
    for r in made.select("a", "b", fp.likeness_of(F.col("x"), F.col("y")).alias("s")).collect():
        assert r["s"] > 0.4, (len(r["a"]), len(r["b"]), r["s"])


def test_a_long_text_can_be_compared_with_a_short_one(spark):
    rng = random.Random(6)
    long = "\n".join(f"{k} {rng.random()}" for k in range(20_000))  # so many digests in one block that its cells don't fit a long
    rows = texts_frame(spark, [(long, "one line"), ("one line", long), (long, long + "\nx")])
    made = rows.withColumns({"x": fp.tables(F.col("a")), "y": fp.tables(F.col("b"))})
    got = [r["s"] for r in made.select(fp.likeness_of(F.col("x"), F.col("y")).alias("s")).collect()]
    assert got[:2] == [0.0, 0.0] and got[2] > 0.99


def test_peeling_gives_the_differing_digests(spark):
    rng = random.Random(12)
    line = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(20, 90)))
    base = [line() for _ in range(400)]
    other = base[:30] + [line() for _ in range(5)] + base[33:]
    df = texts_frame(spark, [("\n".join(base), "\n".join(other)), ("", "one"), ("", "")]).withColumns({"x": fp.digests(F.col("a")), "y": fp.digests(F.col("b"))})
    cut = df.select("x", "y", fp.cells(F.col("x")).alias("p"), fp.cells(F.col("y")).alias("q"))
    for r in fp.differences(cut, "p", "q").collect():
        assert r["stuck"] == 0 and sorted(r["added"]) == sorted({*r["y"]} - {*r["x"]}) and sorted(r["removed"]) == sorted({*r["x"]} - {*r["y"]})


def test_cells_hold_every_digest_once_in_each_part(spark):
    rng = random.Random(13)
    texts = ["\n".join(str(rng.random()) for _ in range(n)) for n in (0, 1, 16, 17, 33, 500)]
    df = spark.createDataFrame([(t,) for t in texts], "a string").select(fp.digests(F.col("a")).alias("x"))
    for r in df.select("x", fp.cells(F.col("x")).alias("c")).collect():
        n = fp.PARTS * fp.CELLS
        blocks = [r["c"][k : k + n] for k in range(0, len(r["c"]), n)]
        for part in range(fp.PARTS):
            own = [c for b in blocks for c in b[part * fp.CELLS : (part + 1) * fp.CELLS]]
            assert sum(c >> 56 for c in own) == len(r["x"]) and sum(own) == sum(r["x"]) + fp.WEIGHT * len(r["x"])


def test_a_very_long_text_takes_time_in_proportion(spark):
    took = []
    for n in (500_000, 2_000_000):
        df = spark.range(1).select(F.concat_ws("\n", F.transform(F.sequence(F.lit(1), F.lit(n // 20)), lambda i: F.sha1(i.cast("string")).substr(1, 19))).alias("t"))
        began = time.time()
        assert df.select(F.size(fp.cells(fp.digests(F.col("t")))).alias("n")).first()["n"] >= n // 20 * 3
        took.append(time.time() - began)
    assert took[1] < 12 * took[0] + 2
