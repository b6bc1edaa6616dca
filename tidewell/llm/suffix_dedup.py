"""Suffix-array dedup: bytes inside strings of WIDTH bytes that start anywhere else too are removed.

Blockwise suffix sorting with a difference cover. Positions whose number modulo PERIOD is in COVER are the cover sample: any
two positions have a common distance below PERIOD at which both meet the sample, so two equal strings of WIDTH bytes hold
equal sampled strings of WIDTH - PERIOD + 1 bytes at one distance. The sample isn't ranked: its strings are named by hash, and
a position is kept when its name stands anywhere else. Then the suffixes that start up to PERIOD - 1 bytes before a kept
position are sorted one bucket at a time (a bucket is a range of their names, a task sorts one) and those that tie over WIDTH bytes
are marked. All other suffixes can't tie and are never sorted, moved or held.

Only ties over WIDTH bytes matter, so suffixes are in order of 64-bit names of their first WIDTH bytes, not of the alphabet.

Defined cases: a null or empty text has no bytes; matches never cross documents; overlapping occurrences within a document
count; repeated rows remove each other whole when they are long enough; texts shorter than WIDTH stay; other columns are carried along; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm import hashing as H
from tidewell.llm.batches import Batch, Named, Table, covered, repeated_elsewhere

WIDTH = 200
PERIOD = 133
# A perfect difference set, each distance modulo 133 occurs once.
COVER = [0, 9, 10, 12, 26, 30, 67, 74, 82, 109, 114, 120]


def cover_size(width: int) -> int:
    return width - PERIOD + 1


class Suffixes:
    def __init__(self, batch: Batch, width: int):
        self.width, self.n = width, len(batch.raw)
        self.rolling = H.Rolling(H.byte_values(6)[batch.raw])
        self.offsets, self.mask = batch.offsets, batch.mask

    def _whole(self, at: np.ndarray, width: int) -> np.ndarray:
        """Those of the positions after which a text has width bytes."""
        doc = np.searchsorted(self.offsets, at, side="right") - 1
        return at[self.offsets[doc + 1] - at >= width]

    def sample(self) -> tuple[np.ndarray, np.ndarray]:
        at = (np.arange(0, self.n, PERIOD)[:, None] + np.array(COVER)).ravel()
        at = self._whole(at[at < self.n], size := cover_size(self.width))
        return at, self.rolling.spans(at, at + size) & self.mask

    def candidates(self, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes that may tie over width bytes: starts and names."""
        at, names = self.sample()
        distinct, place, often = np.unique(names, return_inverse=True, return_counts=True)
        kept = at[(batch.bits[0] | (often > 1))[place]] if len(at) else at
        sums = np.zeros(self.n + 1, np.int64)
        sums[kept + 1] = 1
        sums = np.cumsum(sums)
        near = np.flatnonzero(sums[np.minimum(np.arange(self.n) + PERIOD, self.n)] > sums[:-1])
        near = self._whole(near, self.width)
        return near, self.rolling.spans(near, near + self.width)


def _marked(docs: DataFrame, text: str, width: int) -> Table:
    def sampled(batch: Batch) -> list[Named]:
        return [(np.unique(Suffixes(batch, width).sample()[1]), None)]

    def bucketed(batch: Batch) -> list[Named]:
        return [(np.unique(Suffixes(batch, width).candidates(batch)[1]), None)]

    table = Table(docs, text, [c for c in docs.columns if c not in (text, "kept", "n_bytes", "n_removed", "n_spans")])
    table.ask(sampled, repeated_elsewhere)
    table.ask(bucketed, repeated_elsewhere)
    return table


def removed_bytes(batch: Batch, width: int) -> np.ndarray:
    at, names = Suffixes(batch, width).candidates(batch)
    if not len(at):
        return np.zeros(len(batch.raw), bool)
    _, place, often = np.unique(names, return_inverse=True, return_counts=True)
    return covered(at[(batch.bits[1] | (often > 1))[place]], width, len(batch.raw))


def dedup(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """docs without text, with kept (the bytes left), n_bytes, n_removed, n_spans (maximal removed runs). width: PERIOD at least."""
    table = _marked(docs, text, width)
    schema = T.StructType([*table.fields, T.StructField("kept", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]])

    def work(batch: Batch) -> list[pa.Array]:
        gone, at = removed_bytes(batch, width), batch.offsets
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = at[1:-1][at[1:-1] < len(gone)]
        begins[inner] = gone[inner]
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
        n_removed = sums(gone)
        offsets = np.concatenate([[0], np.cumsum(np.diff(at) - n_removed)]).astype(np.int64)
        kept = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(batch.raw[~gone])]).cast(pa.binary())
        return [*batch.columns, kept, pa.array(np.diff(at)), pa.array(n_removed), pa.array(sums(begins))]

    return table.rows(work, schema)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
SQL: dict[str, str] = {}
