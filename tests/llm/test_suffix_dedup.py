import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from tidewell.llm import batches, suffix_dedup


def brute(rows, width):
    raw = [(t or "").encode() for _, t in rows]
    often = Counter(b[a : a + width] for b in raw for a in range(len(b) - width + 1))
    out = []
    for (i, _), b in zip(rows, raw):
        gone = [False] * len(b)
        for a in range(len(b) - width + 1):
            if often[b[a : a + width]] > 1:
                gone[a : a + width] = [True] * width
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_cover_has_every_distance():
    c = suffix_dedup.COVER
    assert {(a - b) % suffix_dedup.PERIOD for a in c for b in c} == set(range(suffix_dedup.PERIOD))


def made_texts(seed):
    rng = random.Random(seed)
    piece = lambda n: "".join(rng.choice("ab é漢\n") for _ in range(n))
    shared = [piece(rng.randrange(60, 400)) for _ in range(14)]
    rows = []
    for i in range(70):
        t = "".join(rng.choice(shared)[rng.randrange(30) :] if rng.random() < 0.4 else piece(rng.randrange(200)) for _ in range(rng.randrange(6)))
        rows.append((i, t))
    return rows + [(3, rows[8][1]), rows[9], rows[9], (None, "z" * 199), (80, "z" * 200), (81, "y" * 201), (82, None), (83, ""), (84, "ab" * 300), (85, piece(5000))]


def test_against_brute_force_over_many_batches(spark, monkeypatch):
    for seed, size in ((1, 900), (2, 5000), (3, 1 << 20)):
        monkeypatch.setattr(batches, "BATCH_BYTES", size)
        rows = made_texts(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = suffix_dedup.dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 200)


def test_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x", "y", 2.5)], "doc_id long, text string, kept string, n_spans double")
    got = suffix_dedup.dedup(docs)
    assert got.columns == ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"] and got.first()["n_bytes"] == 1
    assert suffix_dedup.dedup(docs.limit(0)).count() == 0
