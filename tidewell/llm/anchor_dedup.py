"""Substring dedup by fixed-block anchors: words that repeat a window of an earlier document are removed.

Reference blocks are BLOCK words long and don't overlap, counted from the start of their document; every rolling window of
BLOCK words of every document probes them. A window of WINDOW = 2 * BLOCK - 1 words holds a whole block, so one of the two
places where a long passage stands has a block that a window of the other hits. Hits are extended: the windows of WINDOW
words around a hit are compared over all documents (the least doc_id that has each), and neighbouring confirmed windows join
into maximal repeats. Probes have shorter names (of 40 bits or more, by the corpus's size), which only choose candidates. Windows are confirmed by
two hashes of 64 bits each with bases of their own, of all their bytes: over 10^14 windows the chance of one false pair is below 10^-10.

Defined cases: words are runs of other bytes than space and 0x09-0x0D, unchanged; null and empty texts have none; a null doc_id counts as larger
than all, equal ids (repeated rows) don't remove from each other; texts shorter than a window stay whole; an empty table gives
an empty result; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm import hashing as H
from tidewell.llm.batches import Batch, Named, Table, covered, least_by_name, least_by_pair, place_of_pair

BLOCK = 7
WINDOW = 2 * BLOCK - 1
LAST = np.iinfo(np.int64).max


class Words:
    """Words of a batch, the order of their documents, hashes of windows."""

    def __init__(self, batch: Batch):
        self.raw, self.mask = batch.raw, batch.mask
        self.starts, self.ends, self.doc = H.words(batch.raw, batch.offsets)
        ids = batch.columns[0]
        self.rank = ids.cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
        self.of = self.rank[self.doc]
        self.rolling = H.Rolling(H.span_hashes(batch.raw, self.starts, self.ends, seed=9))

    def checks(self, at: np.ndarray) -> np.ndarray:
        """Second hashes of the windows of WINDOW words at these places: other byte values, and another base for bytes and for words."""
        base = H.SECOND_BASE
        return H.Rolling(H.span_hashes(self.raw, self.starts, self.ends, seed=77, base=base), base).spans(at, at + WINDOW)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows within one document, and their names."""
        n = max(len(self.doc) - width + 1, 0)
        at = np.flatnonzero(self.doc[:n] == self.doc[width - 1 : width - 1 + n])
        return at, self.rolling.windows(width)[at]

    def blocks_and_probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at, names = self.windows(BLOCK)
        names = names & self.mask
        first = np.searchsorted(self.doc, self.doc[at])
        return at, names, at[own := (at - first) % BLOCK == 0], names[own]


def _sorted_anchors(w: Words) -> list[Named]:
    _, names, _, blocks = w.blocks_and_probes()
    return [(np.unique(blocks), None), (np.unique(names), None)]


def anchors(batch: Batch) -> list[Named]:
    return _sorted_anchors(Words(batch))


def hit_elsewhere(lists: list[tuple[int, list[Named]]]) -> Iterator[tuple[int, np.ndarray]]:
    """A probe's bit: another batch has that block."""
    blocks = np.concatenate([x[0][0] for _, x in lists])
    owner = np.repeat(np.arange(len(lists)), [len(x[0][0]) for _, x in lists])
    order = np.argsort(blocks, kind="stable")
    known, first, often = np.unique(blocks[order], return_index=True, return_counts=True)
    only = np.where(often > 1, -1, owner[order][first]) if len(known) else np.zeros(0)
    for k, (number, x) in enumerate(lists):
        probes = x[1][0]
        if not len(known):
            yield number, np.zeros(len(probes), bool)
            continue
        at = np.minimum(np.searchsorted(known, probes), len(known) - 1)
        yield number, (known[at] == probes) & (only[at] != k)


def candidates(batch: Batch, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Windows of WINDOW words that hold a hit: starts and names."""
    at, names, block_at, blocks = w.blocks_and_probes()
    distinct, place = np.unique(names, return_inverse=True)
    hit = batch.bits[0][place] if len(names) else np.zeros(0, bool)
    if len(blocks):  # within the batch: a block of an earlier document
        known, least = least_by_name(blocks, w.of[block_at])
        k = np.minimum(np.searchsorted(known, names), len(known) - 1)
        hit = hit | ((known[k] == names) & (least[k] < w.of[at]))
        # and its counterpart: the earlier document's windows take part in the comparison
        latest = np.full(len(distinct), np.iinfo(np.int64).min)
        np.maximum.at(latest, place, w.of[at])
        hit = hit | ((known[k] == names) & (latest[place] > w.of[at]))
    sums = np.zeros(len(w.doc) + 1, np.int64)
    sums[1:][at[hit]] = 1
    sums = np.cumsum(sums)
    long_at, long_names = w.windows(WINDOW)
    keep = sums[long_at + WINDOW - BLOCK + 1] > sums[long_at]
    return long_at[keep], long_names[keep]


def confirmed_names(batch: Batch) -> list[Named]:
    w = Words(batch)
    at, names = candidates(batch, w)
    names, checks, least = least_by_pair(names, w.checks(at), w.of[at])
    return [(names, [checks.view(np.int64), least])]


def earlier_elsewhere(lists: list[tuple[int, list[Named]]]) -> Iterator[tuple[int, np.ndarray]]:
    """A window's bit: another batch has it in an earlier document than this one's earliest."""
    known, known_checks, least = least_by_pair(*(np.concatenate(c) for c in zip(*((x[0][0], *x[0][1]) for _, x in lists), strict=True)))
    for number, x in lists:
        names, (checks, own) = x[0]
        yield number, least[place_of_pair(names, checks, known, known_checks)] < own


def repeated_words(batch: Batch, w: Words) -> np.ndarray:
    """Which words lie in a window that an earlier document has."""
    at, names = candidates(batch, w)
    checks = w.checks(at)
    known, known_checks, own = least_by_pair(names, checks, w.of[at])
    k = place_of_pair(names, checks, known, known_checks)
    earlier = (batch.bits[1][k] | (own[k] < w.of[at])) if len(names) else np.zeros(0, bool)
    return covered(at[earlier], WINDOW, len(w.doc))


def joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, n: int) -> pa.Array:
    """For each of n texts its words put together with one space."""
    length = ends - starts + 1
    final = np.ones(len(doc), bool)
    final[:-1] = doc[1:] != doc[:-1]
    length = length - final
    stop = np.cumsum(length)
    index = np.repeat(starts - (stop - length), length) + np.arange(stop[-1] if len(stop) else 0)
    out = np.append(raw, np.uint8(32))[index]
    out[stop[~final] - 1] = 32
    offsets = np.zeros(n + 1, np.int64)
    np.add.at(offsets, doc + 1, length)
    offsets = np.cumsum(offsets)
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.binary())


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with text made of the words kept (one space between), and n_words, n_removed, n_spans: words, removed words, maximal removed runs."""
    others = [c for c in docs.columns if c not in (text, doc_id, "n_words", "n_removed", "n_spans")]
    table = Table(docs.withColumn(doc_id, F.col(doc_id).cast("long")), text, [doc_id, *others])
    table.ask(anchors, hit_elsewhere)
    table.ask(confirmed_names, earlier_elsewhere)
    counts = [T.StructField(c, T.LongType()) for c in ("n_words", "n_removed", "n_spans")]
    schema = T.StructType([*table.fields, T.StructField("_kept", T.BinaryType()), *counts])

    def work(batch: Batch) -> list[pa.Array]:
        w, n = Words(batch), len(batch.offsets) - 1
        gone = repeated_words(batch, w)
        begins = gone.copy()
        begins[1:] &= ~gone[:-1] | (w.doc[1:] != w.doc[:-1])
        kept = joined(w.raw, w.starts[~gone], w.ends[~gone], w.doc[~gone], n)
        made = [np.bincount(d, minlength=n).astype(np.int64) for d in (w.doc, w.doc[gone], w.doc[begins])]
        return [*batch.columns, kept, *map(pa.array, made)]

    out = table.rows(work, schema).withColumn(text, F.col("_kept").cast("string")).drop("_kept")
    return out.select(doc_id, text, *others, "n_words", "n_removed", "n_spans")


def op9_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op9_anchor_dedup": op9_anchor_dedup}
SQL = {
    "op9_anchor_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(doc_id, 9223372036854775807) AS o, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT k, o, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT k, o, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
m AS (SELECT s, min(o) AS first FROM g GROUP BY s),
r AS (SELECT DISTINCT k, unnest(range(i, i + 13)) AS i FROM g JOIN m USING (s) WHERE first < o),
n AS (SELECT k, count(*) AS n FROM r GROUP BY k),
x AS (SELECT k, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d WHERE k IN (SELECT k FROM n)),
t AS (SELECT k, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN r USING (k, i) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN n USING (k) LEFT JOIN t USING (k)
"""
}
