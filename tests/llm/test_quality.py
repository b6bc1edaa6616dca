import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewell.llm import hashing as H
from tidewell.llm import quality


def test_words_and_hashes_against_plain_python():
    import re

    texts = ["Hello  wörld\t漢字 x", "", "  ", "a", "one\x0btwo\x0cthree four five", None, "x" * 50 + " tail", "x" * 50 + " tail"]
    seen = {}
    for a, b, raw, at in H.chunks(pa.array(texts), size=20, rows=3):
        starts, ends, doc = H.words(raw, at)
        got = [[] for _ in range(b - a)]
        for s, e, d, h in zip(starts, ends, doc, H.span_hashes(raw, starts, ends)):
            word = raw[s:e].tobytes()
            got[d].append(word.decode())
            assert seen.setdefault(word, h) == h
        assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts[a:b]]
    assert len({*seen.values()}) == len(seen)


def test_held_out_is_the_contracts(spark):
    rows = spark.range(200).select("id", quality.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = quality.op4_quality(spark, d).toPandas()
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    m = got.merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    m = m[m["held_out"]]
    assert (m["predicted"] == m["quality"]).mean() > 0.94
    assert m[m["quality"] == 1]["predicted"].mean() > 0.98


def test_nulls_repeats_and_missing_labels(spark):
    rows = [(1, "good words here"), (1, "good words here"), (None, "x"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality.judged(docs, none).collect()] == [0.5] * 5
    one = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, quality int")
    assert {r["score"] for r in quality.judged(docs, one).collect()} <= {0.5, 1.0}
    assert quality.judged(docs.limit(0), one).count() == 0


def test_repeated_ids_add_no_training_rows(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids] + [(ids[0], None), (ids[0], "a text")] * 500 + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids] * 2, "doc_id long, quality int")
    got = quality.training_rows(docs, labels).toPandas()
    assert sorted(got["doc_id"]) == ids
    assert got.set_index("doc_id")["text"].to_dict() == {i: f"text {i}" for i in ids} | {ids[0]: "a text"}
    assert (got["y"] == got["doc_id"] % 2).all()
    assert len(quality.training_rows(docs, labels, most=5).toPandas()) == 5


def test_temperature_is_fitted():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 6))
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    later = np.arange(3000) % 5 == 0
    net = quality.Network().fit(x, y, later)
    s = net.score(x[later])
    assert abs(s[s > 0.7].mean() - y[later][s > 0.7].mean()) < 0.06
