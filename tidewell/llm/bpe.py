"""Byte-level BPE encoding and decoding with two tiers of lookup.

Tier one: a minimal perfect hash over the vocabulary resolves every pre-token that is a token as a whole. Tier two: the rest
is merged over a linked list of its bytes, a heap giving the pair of lowest rank (the leftmost of equals) next. Texts are cut
by the tokenizer's pattern, each match on its own, without special tokens, so ids are those of the tiktoken library.

The vocabulary (tens of thousands of entries, whatever the corpus) is read once by the driver's process and broadcast. Each task keeps the
ids of pre-tokens it has met, up to MEMO entries of at most LONGEST characters, then starts anew; that bounds memory and changes no result.

Defined cases: a null or empty text has no ids and decodes to nothing; bytes that are no UTF-8 count as U+FFFD; null ids decode to nothing; repeated
rows are encoded each; an empty table gives an empty result; columns of the input keep their names, "ids" and "decoded" replace such columns.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm import hashing as H
from tidewell.session import bounded_batches

MEMO, LONGEST = 400_000, 64
#: Matches of a text are taken so many at a time.
CHUNK = 200_000
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


class PerfectHash:
    """Minimal perfect hash of the tokens by hash and displace: n slots for n keys."""

    def __init__(self, tokens: dict[bytes, int]):
        n = self.n = len(tokens)
        self.m = max(1, n // 4)
        self.shift = [0] * self.m
        self.keys: list[bytes | None] = [None] * n
        self.ids = [0] * n
        buckets: list[list[tuple[bytes, int]]] = [[] for _ in range(self.m)]
        for key in tokens:
            h = xxhash.xxh3_64_intdigest(key)
            buckets[h % self.m].append((key, h))
        taken = bytearray(n)
        order = sorted(range(self.m), key=lambda b: -len(buckets[b]))
        free = None
        for b in order:
            own = buckets[b]
            if not own:
                break
            if len(own) == 1:  # any free slot, by its number
                free = free if free is not None else iter([s for s in range(n) if not taken[s]])
                slots, self.shift[b] = [next(free)], 0
                self.shift[b] = -slots[0] - 1
            else:
                d = 0
                while True:
                    slots = [self._slot(h, d) for _, h in own]
                    if len(set(slots)) == len(own) and not any(taken[s] for s in slots):
                        break
                    d += 1
                self.shift[b] = d
            for s, (key, _) in zip(slots, own, strict=True):
                taken[s], self.keys[s], self.ids[s] = 1, key, tokens[key]

    def _slot(self, h: int, d: int) -> int:
        return (((h >> 20) + d * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 >> 17 & 0xFFFFFFFFFFF) % self.n

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.m]
        s = -d - 1 if d < 0 else self._slot(h, d)
        return self.ids[s] if self.keys[s] == key else None


def merge(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token that is no token; rank: the tokens' ids."""
    n = len(piece)
    # end[a]: where the part that starts at a ends, 0 once it has been merged into the one before
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get, push, pop = rank.get, heapq.heappush, heapq.heappop
    heap = [(r, a, a + 1, a + 2) for a in range(n - 1) if (r := get(piece[a : a + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, a, mid, stop = pop(heap)
        if end[a] != mid or end[mid] != stop:  # one of the two has been merged meanwhile
            continue
        end[a], end[mid] = stop, 0
        if stop < n:
            before[stop] = a
            if (r := get(piece[a : end[stop]])) is not None:
                push(heap, (r, a, stop, end[stop]))
        if a:
            c = before[a]
            if (r := get(piece[c:stop])) is not None:
                push(heap, (r, c, a, stop))
    out, a = [], 0
    while a < n:
        out.append(rank[piece[a : end[a]]])
        a = end[a]
    return out


class _Memo(dict):
    """Ids of the pre-tokens met so far."""

    def __init__(self, vocabulary: Vocabulary):
        self.ids_of = vocabulary.ids_of

    def __missing__(self, piece: str) -> bytes:
        out = self.ids_of(piece)
        if len(piece) <= LONGEST:
            self[piece] = out
        return out


class Vocabulary:
    """Ranks and pattern of a tokenizer; path: a .tiktoken file."""

    def __init__(self, path: str, pattern: str):
        self.pattern = pattern
        tokens = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
        self.hash = PerfectHash(tokens)
        self.bytes_of = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            self.bytes_of[i] = token
        self.rank = tokens
        self.memo = _Memo(self)

    def __getstate__(self) -> dict:
        return {k: x for k, x in self.__dict__.items() if k != "memo"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"memo": _Memo(self)}

    def ids_of(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "replace")
        one = self.hash.get(raw)
        return array("I", merge(raw, self.rank) if one is None else [one]).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        out, memo = [], self.memo
        found = regex.compile(self.pattern).finditer(text) if len(text) > 4_000_000 else None
        pieces = regex.compile(self.pattern).findall(text) if found is None else [m[0] for m in islice(found, CHUNK)]
        while pieces:
            if len(memo) > MEMO:
                memo.clear()
            out.append(b"".join(map(memo.__getitem__, pieces)))
            pieces = [m[0] for m in islice(found, CHUNK)] if found is not None else []
        return b"".join(out)

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I").tolist())) if ids else b""


def _mapped(df: DataFrame, vocabulary: Vocabulary, source: str, to: str) -> DataFrame:
    """df with a binary column made of another one, a batch of rows at a time."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([f for f in df.schema.fields if f.name != to] + [T.StructField(to, T.BinaryType())])
    names = [f.name for f in schema.fields[:-1]]
    encodes = to == "ids"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        f = v.encode if encodes else v.decode
        for batch in batches:
            given = batch.column(source).cast(pa.binary()).to_pylist()
            if encodes:
                given = [None if x is None else x.decode("utf-8", "replace") for x in given]
            made = pa.array([f(x) for x in given], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), made], [*names, to])
        v.memo.clear()

    return df.mapInArrow(lambda rows: H.tidied(work(rows)), schema)


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """docs with ids: the tokens' ids as little-endian unsigned 32-bit integers in one binary."""
    return _mapped(docs, vocabulary, text, "ids")


def decode(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """docs with decoded: the bytes that ids stand for."""
    return _mapped(docs, vocabulary, ids, "decoded")


@lru_cache(maxsize=4)
def _read(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def default_vocabulary() -> Vocabulary:
    import public_tokenizers as p

    return _read(p.path(VOCABULARY), p.PATTERN)


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of doc_id, text."""
    v = default_vocabulary()
    encoded = encode(docs.select("doc_id", "text"), v).select("doc_id", "ids")
    return decode(encoded, v).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op7_bpe": op7_bpe}
SQL: dict[str, str] = {}
