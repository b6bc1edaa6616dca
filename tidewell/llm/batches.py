"""Texts in batches, and questions about names (hashes of windows) put to all batches at once.

A table of batches holds the texts of many rows back to back, with the other columns as lists. It is written once, dealt to
buckets by batch, so that answers meet it again without moving the texts. A question goes so: each batch gives the sorted
distinct names it holds (with a number for each where needed); the names are cut into ranges, a blob of each range for each
batch; a task gets one range of all batches and answers each batch with one bit for each name. A name is sent once
a batch however often it stands there, so no frequent name makes a large range; a range is sized by the corpus. A batch sends a blob for
each range in which it has names, so there are never more blobs than names.

Batches and ranges grow with the corpus (to MOST_BATCH and MOST_RANGE), the table has MOST_BUCKETS buckets at most. A text of any length stays whole in
its batch: a task takes about 40 bytes for each of its bytes. release() of the session drops the tables.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm import hashing as H
from tidewell.session import bounded_batches, remember_table, stored

BATCH_BYTES, MOST_BATCH = 2 << 20, 8 << 20
RANGE_BYTES, MOST_RANGE = 16 << 20, 64 << 20  # of text, for each range of names
BUCKET_BYTES, MOST_BUCKETS = 16 << 20, 20_000
#: Into so many batches (and ranges) a corpus is cut before they grow.
PIECES = 1 << 16
LEAST_RANGES = 48

#: Names and the numbers that go with them: none, one for each name, or several kinds of them.
Named = tuple[np.ndarray, np.ndarray | list[np.ndarray] | None]


def sizes(total: int) -> tuple[int, int, int]:
    """Bytes of a batch, number of ranges and number of buckets for a corpus of total bytes."""
    batch = min(max(total // PIECES, BATCH_BYTES), MOST_BATCH)
    span = min(max(total // PIECES, RANGE_BYTES), MOST_RANGE)
    return batch, max(LEAST_RANGES, math.ceil(total / span)), min(max(4, math.ceil(total / BUCKET_BYTES)), MOST_BUCKETS)


class Batch:
    """One row of the table: number (of its first row), raw bytes, offsets, lists of the carried columns, mask of short names, picked rows, and bits by question."""

    def __init__(self, rows: pa.RecordBatch, i: int, carried: int, mask: np.uint64):
        self.mask = mask
        col = lambda name: rows.column(rows.schema.get_field_index(name))[i]
        self.number = col("batch").as_py()
        self.raw = np.frombuffer(col("raw").as_buffer(), np.uint8)
        self.offsets = col("offsets").values.to_numpy().astype(np.int64)
        self.nulls = col("nulls").values
        self.columns = [col(f"c{k}").values for k in range(carried)]
        self.picked: np.ndarray | None = None
        if (at := rows.schema.get_field_index("picked")) >= 0:
            got = rows.column(at)[i]
            self.picked = np.sort(got.values.to_numpy(zero_copy_only=False).astype(np.int64)) - self.number if got.is_valid else np.zeros(0, np.int64)
        self.bits: list[np.ndarray] = []
        k = 0
        while (at := rows.schema.get_field_index(f"bits{k}")) >= 0:
            parts = sorted(rows.column(at)[i].as_py() or [], key=lambda p: p["part"])
            planes = max((p["planes"] for p in parts), default=1)
            bits = [np.unpackbits(np.frombuffer(p["bits"], np.uint8), count=p["n"] * planes).reshape(planes, p["n"]).astype(bool) for p in parts]
            bits = np.concatenate([np.zeros((planes, 0), bool), *bits], axis=1)
            self.bits.append(bits[0] if planes == 1 else bits)
            k += 1


class Table:
    """df: the table's rows; schema: of the carried columns; ranges: into how many names are cut."""

    def __init__(self, docs: DataFrame, text: str, carry: list[str]):
        spark = docs.sparkSession
        bounded_batches(spark)
        picked = docs.select(F.col(f"`{text}`").cast("binary").alias("text"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)])
        self.fields = [docs.schema[c] for c in carry]
        kinds = [f.dataType for f in picked.schema.fields[1:]]
        schema = T.StructType(
            [T.StructField("batch", T.LongType()), T.StructField("offsets", T.ArrayType(T.LongType())), T.StructField("raw", T.BinaryType()), T.StructField("nulls", T.ArrayType(T.BooleanType()))]
            + [T.StructField(f"c{k}", T.ArrayType(t)) for k, t in enumerate(kinds)]
        )
        n = len(carry)
        self.size = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        batch_bytes, self.ranges, buckets = sizes(self.size)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, waiting, size = TaskContext.get().partitionId() << 38, [], 0

            def flush() -> pa.RecordBatch:
                nonlocal number
                t = pa.Table.from_batches(waiting).combine_chunks()
                raw, at = H.buffers(t.column("text").combine_chunks() if t.num_rows else pa.array([], pa.binary()))
                number += t.num_rows
                nulls = pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), _flat(t.column("text")).is_null())
                lists = [pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), _flat(t.column(f"c{k}"))) for k in range(n)]
                return pa.RecordBatch.from_arrays(
                    [pa.array([number - t.num_rows]), pa.array([at]), pa.array([raw.tobytes()], pa.binary()), nulls, *lists], [f.name for f in schema.fields]
                )

            for b in batches:
                raw_at = H.buffers(b.column("text"))[1]
                a = 0
                while a < b.num_rows:
                    e = int(np.searchsorted(raw_at, raw_at[a] + batch_bytes - size, side="right")) - 1
                    e = min(max(e, a if waiting else a + 1), b.num_rows)
                    if e > a:
                        waiting.append(b.slice(a, e - a))
                        size += int(raw_at[e] - raw_at[a])
                    if e < b.num_rows or size >= batch_bytes:
                        yield flush()
                        waiting, size = [], 0
                    a = e
            if waiting:
                yield flush()

        made = picked.mapInArrow(lambda rows: H.tidied(work(rows)), schema)
        name = f"tidewell_batches_{uuid.uuid4().hex}"
        remember_table(spark, name)
        made.write.option("compression", "zstd").option("parquet.block.size", str(8 << 20)).option("parquet.block.row.count.limit", "4").bucketBy(buckets, "batch").saveAsTable(name)
        self.df = spark.table(name)
        self.bits: list[DataFrame] = []
        self.picked: DataFrame | None = None

    def mask(self) -> np.uint64:
        """Bits of a name that are kept where names only choose candidates: 12 more than it takes to number the corpus's bytes."""
        kept = min(64, max(40, self.size.bit_length() + 12))
        return np.uint64((1 << 64) - (1 << (64 - kept)))

    def pick(self, rows: DataFrame) -> None:
        """rows (batch, key): from now on batch.picked has their places in the batch; a row's key is its batch's number and its place, added."""
        self.picked = stored(rows.groupBy("batch").agg(F.collect_list("key").alias("picked")))

    def _with_bits(self) -> DataFrame:
        out = self.df if self.picked is None else self.df.join(self.picked, "batch", "left")
        for k, bits in enumerate(self.bits):
            out = out.join(bits.withColumnRenamed("bits", f"bits{k}"), "batch", "left")
        return out

    def ask(self, names: Callable[[Batch], list[Named]], answer: Callable[[list[tuple[int, list[Named]]]], Iterator[tuple[int, np.ndarray]]]) -> None:
        """Put a question; its bits (for the last of the lists that names gives) are in batch.bits from then on.

        answer gets (batch, lists) of one range for every batch that has names there, and gives (batch, bits); bits may have
        several rows, planes of one bit for each name.
        """
        ranges, carried, mask = self.ranges, len(self.fields), self.mask()

        def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in rows:
                for i in range(r.num_rows):
                    batch = Batch(r, i, carried, mask)
                    lists = names(batch)
                    of = [_range_of(n, ranges) for n, _ in lists]
                    full = np.unique(np.concatenate(of))
                    cuts = [(np.searchsorted(r, full), np.searchsorted(r, full, side="right")) for r in of]
                    cut = lambda k, a, e: (lists[k][0][a:e], [v[a:e] for v in _kinds(lists[k][1])])  # noqa: E731, B023
                    blobs = [pack([cut(k, int(a[p]), int(e[p])) for k, (a, e) in enumerate(cuts)]) for p in range(len(full))]
                    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([batch.number] * len(full), pa.int64()), pa.array(blobs, pa.binary())], ["part", "batch", "blob"])

        def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
            part, out = pdf["part"].iloc[0], []
            for number, bits in answer([(int(b), unpack(x)) for b, x in zip(pdf["batch"], pdf["blob"], strict=True)]):
                out.append((number, part, bits.shape[-1], bits.ndim == 1 or len(bits), np.packbits(bits).tobytes()))
            H.give_back()
            return pd.DataFrame(out, columns=["batch", "part", "n", "planes", "bits"])

        asked = self._with_bits().mapInArrow(lambda rows: H.tidied(emit(rows)), "part int, batch long, blob binary")
        bits = asked.groupBy("part").applyInPandas(reduce, "batch long, part int, n int, planes int, bits binary")
        self.bits.append(stored(bits.groupBy("batch").agg(F.collect_list(F.struct("part", "n", "planes", "bits")).alias("bits"))))

    def rows(self, work: Callable[[Batch], list[pa.Array]], schema: T.StructType) -> DataFrame:
        """What work gives for each batch: the columns of schema."""
        carried, mask, names = len(self.fields), self.mask(), [f.name for f in schema.fields]

        def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in rows:
                for i in range(r.num_rows):
                    yield pa.RecordBatch.from_arrays(work(Batch(r, i, carried, mask)), names)

        return self._with_bits().mapInArrow(lambda rows: H.tidied(each(rows)), schema)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    out = column.combine_chunks()
    return out if isinstance(out, pa.Array) else pa.concat_arrays(out.chunks) if out.num_chunks else pa.array([], column.type)


def _range_of(names: np.ndarray, ranges: int) -> np.ndarray:
    return ((names >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _planes(a: np.ndarray) -> bytes:
    """Differences of neighbours, byte by byte: few bytes are left where many values are near each other."""
    d = a.view(np.uint64).copy()
    d[1:] -= a.view(np.uint64)[:-1]
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(b: memoryview, n: int) -> np.ndarray:
    d = np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, n).T).reshape(-1).view(np.uint64)
    return np.cumsum(d, dtype=np.uint64)


def _kinds(values: np.ndarray | list[np.ndarray] | None) -> list[np.ndarray]:
    return values if isinstance(values, list) else [] if values is None else [values]


def pack(lists: list[Named]) -> bytes:
    lists = [(n, _kinds(v)) for n, v in lists]
    head = np.array([len(lists), *(x for n, v in lists for x in (len(n), len(v)))], np.int32)
    return b"".join([head.tobytes(), *(_planes(x) for n, v in lists for x in (n, *v))])


def unpack(blob: bytes) -> list[Named]:
    m = int(np.frombuffer(blob, np.int32, 1)[0])
    head, at, out, view = np.frombuffer(blob, np.int32, 2 * m, 4), 4 + 8 * m, [], memoryview(blob)
    for n, more in head.reshape(m, 2):
        n = int(n)
        columns = [_unplanes(view[at + 8 * n * k : at + 8 * n * (k + 1)], n) for k in range(int(more) + 1)]
        at += 8 * n * len(columns)
        values = [v.view(np.int64) for v in columns[1:]]
        out.append((columns[0], values if len(values) > 1 else values[0] if values else None))
    return out


def least_by_name(names: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct names, and the least value of each."""
    order = np.lexsort((values, names))
    n, v = names[order], values[order]
    first = np.ones(len(n), bool)
    first[1:] = n[1:] != n[:-1]
    return n[first], v[first]


def least_by_pair(names: np.ndarray, checks: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs of names and checks, and the least value of each."""
    order = np.lexsort((values, checks, names))
    n, c, v = names[order], checks[order], values[order]
    first = np.ones(len(n), bool)
    first[1:] = (n[1:] != n[:-1]) | (c[1:] != c[:-1])
    return n[first], c[first], v[first]


def place_of_pair(names: np.ndarray, checks: np.ndarray, known: np.ndarray, known_checks: np.ndarray) -> np.ndarray:
    """Where each pair stands among the known ones (least_by_pair()), which hold them all."""
    at = np.searchsorted(known, names)
    while len(off := np.flatnonzero(known_checks[at] != checks)):  # several known pairs share a name
        at[off] += 1
    return at


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of width that begins at one of starts."""
    sums = np.zeros(n + 1, np.int64)
    sums[starts + 1] = 1
    sums = np.cumsum(sums)
    out = sums[1:].copy()
    out[width:] -= sums[1 : n + 1 - width] if n > width else 0
    return out > 0


def repeated_elsewhere(lists: list[tuple[int, list[Named]]]):
    """A name's bit: another batch has it too."""
    known, often = np.unique(np.concatenate([x[0][0] for _, x in lists]), return_counts=True)
    for number, x in lists:
        yield number, often[np.searchsorted(known, x[0][0])] > 1
