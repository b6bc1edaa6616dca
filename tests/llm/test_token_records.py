import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.llm import crc32c
from tidewell.llm import token_records as R

ODD = [
    None,
    "",
    " ",
    "It's  a\ttest\n\nOF words",
    "éä Å x y　z İstanbul ΣΣ don't 12345",
    "a\x1cb \x85 c d <|endoftext|> <|startoftext|>x",
    "x" * 9000,
    "Hello, World. AÀ ß÷×ÿ. <|EndOfText|>. <|endoftext|>, <b>Bold</b> it's. don't! A.B., a.. ?! Ünï. 'S l'Été Ÿ Ÿ. á. e.\u0301 1. x1. <a.",
    "中文字 " * 50,
    "word and more " * 3000,
    "\U0001f600‍\U0001f600 กำ",
]


def want(rows):
    t = Tokenizer.from_file(P.path(R.VOCABULARY))
    out, start = [], 0
    for d, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, R.END]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_equals_the_library(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 4000)  # texts in pieces
    rows = [(3 * i, x) for i, x in enumerate(ODD)]
    df = spark.createDataFrame(rows[::-1], "doc_id long, text string").withColumns({"file": F.lit(1), "record": F.lit("x"), "ids": F.lit(2)})
    assert sorted(map(tuple, R.written_and_read(df).collect())) == want(rows)


def test_files_index_and_shuffled_reads(spark, tmp_path):
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(-3, 300)] + [(5, "again")] * 2 + [(None, "no id")]
    index = R.write(spark.createDataFrame(rows, "doc_id long, text string"), R.default_tokenizer(), path=str(tmp_path), file_bytes=2000).collect()
    index.sort(key=lambda r: (r["file"], r["record"]))
    ids = [r["doc_id"] for r in index]
    assert len({r["file"] for r in index}) > 2 and ids[0] is None and ids[1:] == sorted(r[0] for r in rows if r[0] is not None)
    for r in index:  # each record stands by itself at its offset
        with open(r["file"], "rb") as f:
            f.seek(r["offset"])
            frame = f.read(r["size"])
        n, check = struct.unpack("<QI", frame[:12])
        assert n == r["size"] - 16 and check == int(crc32c.masked(crc32c.checksums([frame[:8]]))[0])
        doc_ids, found, many = R.parsed([frame[12:-4]])
        assert doc_ids == [r["doc_id"]] and many.tolist() == [len(found)] == [r["n_tokens"]] and found[-1] == R.END
    df = spark.createDataFrame(index, R.INDEX)
    whole = {(r["file"], r["record"]): (r["doc_id"], r["before"], bytes(r["ids"])) for r in R.read(df.select("file").distinct()).collect()}
    assert {k: v[:2] for k, v in whole.items()} == {(r["file"], r["record"]): (r["doc_id"], r["before"]) for r in index}
    first, again, other = ([(r["file"], r["record"], r["doc_id"], r["before"], bytes(r["ids"])) for r in R.read_shuffled(df, seed, 3000).orderBy("place").collect()] for seed in (1, 1, 2))
    assert first == again != other and sorted(map(repr, first)) == sorted(map(repr, other))
    assert {x[:2]: x[2:] for x in first} == whole


def test_damage_is_found(spark, tmp_path):
    df = spark.createDataFrame([(1, "some words"), (2, "more words")], "doc_id long, text string")
    file = R.write(df, R.default_tokenizer(), path=str(tmp_path)).first()["file"]
    good = open(file, "rb").read()
    for bad, said in ((good[:20] + bytes([good[20] ^ 1]) + good[21:], "checksum"), (good[:-3], "ends within")):
        open(file, "wb").write(bad)
        with pytest.raises(Exception, match=said):
            R.read(spark.createDataFrame([(file,)], "file string")).collect()


def test_checksums_and_varints():
    assert int(crc32c.checksums([b"123456789"])[0]) == 0xE3069283
    rng = np.random.default_rng(1)
    strings = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 3, 4, 5, 511, 512, 513, 1024, 1025, 5000, 2560, 0, 7)]
    assert crc32c.checksums(strings).tolist() == [crc32c._short(x) for x in strings]
    ids = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1, 2**28, 2**32 - 1] * 3, "<u4")
    packed, sizes = R.varints(ids)
    assert packed == b"".join(R.varint(int(i)) for i in ids) and sizes.sum() == len(packed)
    assert R.unpacked(packed).tolist() == ids.tolist()
    for d in (None, 0, -5, 2**63 - 1, -(2**63)):
        assert R.parsed([R.example(d, packed)])[0] == [d]
    doc_ids, found, many = R.parsed([R.example(1, packed), R.example(2, b""), R.example(3, b"\x05")])
    assert doc_ids == [1, 2, 3] and many.tolist() == [len(ids), 0, 1] and found.tolist() == [*ids.tolist(), 5]


def test_empty_table(spark):
    assert R.written_and_read(spark.createDataFrame([], "doc_id long, text string")).collect() == []
