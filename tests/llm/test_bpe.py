import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from tidewell.llm import bpe


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.default_vocabulary()


@pytest.fixture(scope="module")
def library(vocabulary):
    ranks = {b: i for i, b in enumerate(vocabulary.bytes_of)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_hash_is_minimal_and_perfect(vocabulary):
    h = vocabulary.hash
    assert h.n == len(vocabulary.bytes_of) and None not in h.keys
    assert all(h.get(b) == i for i, b in enumerate(vocabulary.bytes_of))
    assert h.get(b"no such token at all") is None


def test_ids_are_the_librarys(vocabulary, library):
    rng = random.Random(1)
    texts = ["", " ", "a", "it's   here\n\n", "ñandú été 你好 🎉🎉 \u0000x", "a" * 3000, "%%%&&&***" * 50, "0123456789" * 30, "<|endoftext|>"]
    texts += ["".join(rng.choice("abc theÄß\n 1%漢") for _ in range(rng.randrange(400))) for _ in range(300)]
    for t in texts:
        got = vocabulary.encode(t)
        assert list(memoryview(got).cast("I")) == library.encode_ordinary(t)
        assert vocabulary.decode(got) == t.encode()


def test_long_text_in_chunks(vocabulary, library, monkeypatch):
    t = "the quick brown fox " * 220_000
    assert list(memoryview(vocabulary.encode(t)).cast("I")) == library.encode_ordinary(t)


def test_query_with_nulls_and_repeats(spark, library):
    rows = [(1, "Hello wörld"), (1, "Hello wörld"), (None, "x"), (2, None), (3, "")]
    got = sorted(map(tuple, bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bytes_that_are_no_utf8_and_long_pieces(spark):
    df = spark.sql("SELECT 1 AS doc_id, cast(X'6162ff63' AS string) AS text UNION ALL SELECT 2, repeat('x', 3000) UNION ALL SELECT 3, NULL UNION ALL SELECT 4, ''")
    v = bpe.default_vocabulary()
    assert bpe.default_vocabulary() is v
    got = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(bpe.encode(df, v), v).collect()}
    assert got == {1: "ab\ufffdc".encode(), 2: b"x" * 3000, 3: b"", 4: b""}
    memo = bpe._Memo(v)
    memo["y" * 70], memo["ab"]
    assert [*memo] == ["ab"]
