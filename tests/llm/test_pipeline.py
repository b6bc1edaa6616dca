import base64
import hashlib
import importlib.util
from collections import Counter
from pathlib import Path

import public_tokenizers
import tiktoken

import corpus_pipeline
from tidewell.llm import bpe, mixing, quality
from tidewell.session import stored

DIR = "/root/testdata/sf0.001"


def _brute(name):
    spec = importlib.util.spec_from_file_location(f"_{name}", Path(__file__).parent / f"{name}.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.brute


def test_each_stage_against_a_plain_version_of_it(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    near, anchors = _brute("test_ngram_join"), _brute("test_anchor_dedup")
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, DIR))
        before, after = docs.collect(), out.collect()
        if name != "token_ids":
            assert out.columns == docs.columns
        if name == "quality":
            labels = spark.read.parquet(f"{DIR}/labels.parquet")
            good = {r["doc_id"] for r in quality.judged(docs, labels).where("predicted = 1").collect()}
            assert Counter(after) == Counter(r for r in before if r["doc_id"] in good)
        elif name == "near_duplicates":
            keep = {c for _, n, c in near([(r["doc_id"], r["text"]) for r in before]) if n}
            empty = {r["doc_id"] for r in before if not (r["text"] or "").strip(" \t\n\x0b\x0c\r")}
            assert {r["doc_id"] for r in after} == keep | empty and len(after) == len(keep | empty)
        elif name == "repeated_passages":
            want = {(i, sha) for i, _, _, sha in anchors([(r["doc_id"], r["text"]) for r in before])}
            assert {(r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in after} == want
            assert all(r["n_chars"] == len(r["text"]) for r in after)
        elif name == "source_mix":
            times = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mixed(docs).collect() if r["taken"]}
            assert Counter(r["doc_id"] for r in after) == times and max(times.values()) <= mixing.MOST
        else:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.VOCABULARY), "rb"))}
            encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            want = Counter((r["doc_id"], b"".join(i.to_bytes(4, "little") for i in encoding.encode_ordinary(r["text"]))) for r in before)
            assert Counter((r["doc_id"], bytes(r["ids"])) for r in after) == want
        docs = out


def _folder(spark, tmp_path, rows):
    kind = "doc_id long, text string, source string, lang string, n_chars long, ids string, batch int, _text string, times int, size long, n_words long"
    df = spark.createDataFrame([(i, t, s, None, len(t) if t else None, f"x{i}", 1, "u", 9, 4, 7) for i, t, s in rows], kind)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), df


def test_stages_keep_columns_whatever_their_names_and_values(spark, tmp_path):
    words = [f"word{k}" for k in range(30)]
    rows = [(1, " ".join(words), "a"), (1, " ".join(words), "a"), (2, " ".join([*words, "more"]), None), (3, None, "a"), (4, "", None), (5, "x " * 5000, "b"), (None, "no id here at all", "b")]
    folder, df = _folder(spark, tmp_path, rows)
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder))
        assert docs.columns == df.columns, name
        assert docs.where("batch <> 1 OR _text <> 'u' OR times <> 9 OR size <> 4 OR n_words <> 7").count() == 0
    assert {r["doc_id"] for r in docs.collect()} <= {1, 2, 5, None} and docs.count() > 0
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and out.count() == docs.count()


def test_an_empty_table_gives_an_empty_result(spark, tmp_path):
    folder, _ = _folder(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, folder).count() == 0
