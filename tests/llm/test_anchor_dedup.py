import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import anchor_dedup, batches


def brute(rows):
    key = lambda i: (i is None, i or 0)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words):
        for a in range(len(w) - 12):
            g = tuple(w[a : a + 13])
            least[g] = min(least.get(g, key(i)), key(i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for a in range(len(w) - 12):
            if least[tuple(w[a : a + 13])] < key(i):
                gone.update(range(a, a + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def made_texts(seed, n=160):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "a"]) if rng.random() < 0.3 else "".join(rng.choice("abcdeé漢") for _ in range(rng.randrange(1, 6)))
    passages = [[word() for _ in range(rng.randrange(10, 40))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(0, 6)):
            w += rng.choice(passages)[rng.randrange(4) :] if rng.random() < 0.5 else [word() for _ in range(rng.randrange(30))]
        rows.append((i * 7 % n, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(3, rows[0][1]), rows[5], rows[5], (None, rows[9][1]), (None, rows[9][1]), (500, None), (501, ""), (502, "  "), (503, "x " * 400), (2, "x " * 30)]
    return rows


def test_against_brute_force_over_many_batches(spark, monkeypatch):
    for seed, size in ((1, 600), (2, 4000), (3, 1 << 20)):
        monkeypatch.setattr(batches, "BATCH_BYTES", size)
        rows = made_texts(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = anchor_dedup.dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256))
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_other_columns_are_carried_and_empty_tables(spark):
    docs = spark.createDataFrame([(2, "b", "x", [1]), (1, None, None, None)], "doc_id long, text string, raw string, batch array<int>").withColumn("n_words", F.lit(9))
    got = anchor_dedup.dedup(docs)
    assert {(r["doc_id"], r["raw"], tuple(r["batch"] or ()), r["text"], r["n_words"]) for r in got.collect()} == {(2, "x", (1,), "b", 1), (1, None, (), "", 0)}
    assert anchor_dedup.dedup(docs.limit(0)).count() == 0


def test_blobs_come_back():
    rng = np.random.default_rng(1)
    names = np.unique(rng.integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2))
    values = rng.integers(-5, 2**62, len(names))
    got = batches.unpack(batches.pack([(names, values), (names[:0], None), (names, None)]))
    assert (got[0][0] == names).all() and (got[0][1] == values).all() and not len(got[1][0]) and (got[2][0] == names).all() and got[2][1] is None


def test_pairs_of_hashes_tell_windows_of_one_name_apart():
    names = np.array([5, 5, 5, 9, 9, 2], np.uint64)
    checks = np.array([1, 2, 2, 7, 8, 0], np.int64)
    known, known_checks, least = batches.least_by_pair(names, checks, np.array([30, 20, 10, 4, 5, 6]))
    assert list(zip(known.tolist(), known_checks.tolist(), least.tolist())) == [(2, 0, 6), (5, 1, 30), (5, 2, 10), (9, 7, 4), (9, 8, 5)]
    assert batches.place_of_pair(names, checks, known, known_checks).tolist() == [1, 2, 2, 3, 4, 0]


def test_pieces_stay_bounded_at_any_size():
    for total in (0, 1 << 20, 1 << 30, 1 << 40, 100 << 40):
        batch, ranges, buckets = batches.sizes(total)
        assert 2 << 20 <= batch <= 8 << 20 and 4 <= buckets <= 20_000
        assert ranges >= 48 and total / ranges <= 64 << 20
    assert batches.sizes(30 << 30)[0] == batches.sizes(1 << 30)[0]
