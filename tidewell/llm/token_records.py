"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

Texts are dealt to tasks by ranges of ids and sorted there; each task writes one file of records. A record is framed as in TFRecord files:
length (8 bytes, little-endian), masked CRC-32C of the length, the data, masked CRC-32C of the data. Data is a serialized tf.train.Example with
the features doc_id (left out where null) and input_ids, integers as packed varints. The index is a Parquet table: for each record its file,
number, offset and size, ids before it in the file, and number of ids. A file's name holds an id of the task's attempt, and the
index is committed by Spark, so files of lost or repeated attempts are named nowhere and never read.

Encoding: white space separates pre-tokens in the tokenizer's pattern and normalizer, so a text's ids are those of its words one after the other.
Each batch of texts is reduced to its distinct words (Arrow dictionary, exact); the library encodes those a task hasn't met. The memo starts anew at
MEMO words, which changes no result. Texts are taken in pieces of CHUNK bytes cut at spaces, records built for about as many at a time.

Files are written through pyarrow's file systems, by the path's scheme. Records go to the shared folder unless a path is given.

Defined cases: a null or empty text has the end id alone; bytes that are no UTF-8 count as U+FFFD; null ids come first, equal ids lie side by
side by a hash of their texts, each row with a record; other columns are not carried; an empty table writes no file and gives an
empty index; a frame with a wrong checksum or a cut end raises.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
import string
import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm import crc32c
from tidewell.llm import hashing as H
from tidewell.session import bounded_batches, scratch, stored

VOCABULARY, END = "word_bpe_49k.json", 2
FILE_BYTES = 64 << 20  # of text
CHUNK, MEMO, LONGEST = 5 << 20, 600_000, 64
#: Signs and letters that may be handled by shortcuts: see Encoder.
SIGNS = ".,;:!?"
LETTERS = string.ascii_lowercase + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))
_PLAIN = re.compile(f"[{LETTERS}]+").fullmatch
_SIGN, _LETTER = (np.isin(np.arange(256), np.frombuffer(x.encode(), np.uint8)) for x in (SIGNS, string.ascii_letters))
INDEX = "doc_id long, file string, record long, offset long, size long, before long, n_tokens long"
RECORD = "doc_id long, file string, record long, before long, ids binary"


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it."""
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# ---- words to ids


class Encoder:
    """Ids of texts by a tokenizer given as JSON, which must take white space for a boundary.

    Three shortcuts make fewer distinct words, and go only where a probe of the tokenizer shows that they change nothing: capitals of ASCII become small,
    one sign behind a letter at a word's end is a word of its own, and words of LETTERS alone go straight to the model.
    """

    def __init__(self, json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = self.tokenizer = Tokenizer.from_str(json)
        normal = t.normalizer.normalize_str if t.normalizer else str
        cut = (lambda x: [y for y, _ in t.pre_tokenizer.pre_tokenize_str(x)]) if t.pre_tokenizer else lambda x: [x]
        capitals = string.ascii_uppercase
        self.memo: dict[bytes, bytes] = {}
        self.lowers = normal(capitals) == capitals.lower()
        self.parts = all(normal(f"a{x}") == f"a{x}" and cut(f"aa{x}") == [*cut("aa"), *cut(x)] for x in SIGNS)
        alone = {x: cut(x) for x in LETTERS}
        self.plain = normal(LETTERS) == LETTERS and all(len(x) == 1 for x in alone.values()) and cut(LETTERS) == ["".join(alone[x][0] for x in LETTERS)]
        self.spelled = str.maketrans({x: y[0] for x, y in alone.items()})

    def _of_words(self, words: list[bytes]) -> list[bytes]:
        memo, model = self.memo, self.tokenizer.model
        if len(memo) > MEMO:
            memo.clear()
        out = list(map(memo.get, words))
        other: list[tuple[int, str]] = []
        for i in [i for i, x in enumerate(out) if x is None]:
            w = words[i].decode("utf-8", "replace")
            if self.plain and _PLAIN(w):
                out[i] = array("I", [x.id for x in model.tokenize(w if w.isascii() else w.translate(self.spelled))]).tobytes()
                if len(words[i]) <= LONGEST:
                    memo[words[i]] = out[i]
            else:
                other.append((i, w))
        for (i, _), e in zip(other, self.tokenizer.encode_batch_fast([w for _, w in other], add_special_tokens=False), strict=True):
            out[i] = array("I", e.ids).tobytes()
            if len(words[i]) <= LONGEST:
                memo[words[i]] = out[i]
        return out

    def ids(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie back to back, and how many each has."""
        starts, ends, text = H.words(raw, at)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(at) - 1, np.int64)
        if self.parts:
            sign = _SIGN[raw[ends - 1]] & _LETTER[raw[ends - 2]] & (ends - starts > 1)
            again = 1 + sign
            second = (np.cumsum(again) - 1)[sign]
            starts, ends, text = (np.repeat(x, again) for x in (starts, ends, text))
            starts[second] = ends[second] - 1
            ends[second - 1] -= 1
        low = raw
        if self.lowers:
            low = H.lowered(raw)
            if len(angles := np.flatnonzero(raw == ord("<"))):  # names of special tokens stay as they are
                for i in np.unique(np.searchsorted(starts, angles, side="right") - 1):
                    low[starts[i] : ends[i]] = raw[starts[i] : ends[i]]
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(ends - starts, out=offsets[1:])
        data = low[H.in_word(raw)]
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        own = self._of_words(words.dictionary.to_pylist())
        code, flat = words.indices.to_numpy(), np.frombuffer(b"".join(own), "<u4")
        n = np.array([len(x) // 4 for x in own], np.int32)
        first = np.cumsum(n, dtype=np.int32) - n
        many = n[code]
        begin = np.cumsum(many, dtype=np.int32) - many
        ids = flat[np.repeat(first[code] - begin, many) + np.arange(int(begin[-1] + many[-1]), dtype=np.int32)]
        return ids, np.bincount(text, many, len(at) - 1).astype(np.int64)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(json: str) -> Encoder:
    key = hashlib.sha256(json.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(json)
    return _ENCODERS[key]


def _cuts(text: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of about CHUNK bytes, cut before a space."""
    done = 0
    while done < len(text):
        cut = done + CHUNK
        while cut < len(text) and text[cut] not in H.SPACES:
            ahead = np.flatnonzero(np.isin(text[cut : cut + CHUNK], H.SPACES))
            cut += int(ahead[0]) if len(ahead) else CHUNK
        yield done, min(cut, len(text))
        done = cut


def encoded(encoder: Encoder, texts: pa.Array, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For groups of whole texts: the first one's number, the ids of all (end behind each text), and how many each has."""
    for a, b, raw, at in H.chunks(texts, CHUNK, 1 << 14):
        if b == a + 1:
            ids = np.concatenate([np.zeros(0, "<u4"), *(encoder.ids(raw[x:y], np.array([0, y - x]))[0] for x, y in _cuts(raw))])
            n = np.array([len(ids)], np.int64)
        else:
            ids, n = encoder.ids(raw, at)
        out = np.full(len(ids) + len(n), end, "<u4")
        out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
        yield a, out, n + 1


# ---- ids to records


def varint(n: int) -> bytes:
    out, n = bytearray(), n & (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def varints(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Unsigned 32-bit integers as varints back to back, and the bytes of each."""
    out, sizes = [], np.ones(len(ids), np.int64)
    for k in (7, 14, 21, 28):
        sizes += ids >> np.uint32(k) > 0
    for a in range(0, len(ids), 1 << 20):
        own, size = ids[a : a + (1 << 20)], sizes[a : a + (1 << 20)]
        wide = int(size.max())
        m = np.zeros((len(own), wide), np.uint8)
        for k in range(wide):
            m[:, k] = own >> np.uint32(7 * k) & np.uint32(127) | np.where(size > k + 1, 128, 0).astype(np.uint32)
        out.append(m[np.arange(wide) < size[:, None]].tobytes())
    return b"".join(out), sizes


def unpacked(data: bytes | memoryview) -> np.ndarray:
    """The unsigned 32-bit integers of packed varints."""
    b = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(b < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    out = b[first].astype("<u4") & 127 if len(last) else np.zeros(0, "<u4")
    sizes = last - first + 1
    for k in range(1, int(sizes.max(initial=1))):
        more = np.flatnonzero(sizes > k)
        out[more] |= (b[first[more] + k].astype("<u4") & 127) << np.uint32(7 * k)
    return out


def _field(number: int, data: bytes) -> bytes:
    return bytes([number << 3 | 2]) + varint(len(data)) + data


def _feature(name: bytes, packed: bytes) -> bytes:
    return _field(1, _field(1, name) + _field(2, _field(3, _field(1, packed))))


def example(doc_id: int | None, packed: bytes) -> bytes:
    """A serialized tf.train.Example."""
    return _field(1, (_feature(b"doc_id", varint(doc_id)) if doc_id is not None else b"") + _feature(b"input_ids", packed))


def _fields(data: memoryview) -> Iterator[tuple[int, memoryview]]:
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            out |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return out

    while at < len(data):
        key, size = number(), number()
        yield key >> 3, data[at : at + size]
        at += size


def _inside(data: memoryview, *path: int) -> memoryview:
    for k in path:
        data = next((x for n, x in _fields(data) if n == k), data[:0])
    return data


def _parts(data: bytes) -> tuple[int | None, memoryview]:
    """doc_id and packed ids of an example."""
    doc_id, ids = None, memoryview(b"")
    for _, entry in _fields(_inside(memoryview(data), 1)):
        name, packed = bytes(_inside(entry, 1)), _inside(entry, 2, 3, 1)
        if name == b"input_ids":
            ids = packed
        elif name == b"doc_id":
            n = sum((b & 127) << 7 * k for k, b in enumerate(packed))
            doc_id = n - (1 << 64) if n >> 63 else n
    return doc_id, ids


def parsed(data: list[bytes]) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Of examples: doc_ids, all ids, and how many each has."""
    parts = [_parts(x) for x in data]
    packed = b"".join(x for _, x in parts)
    ends = np.cumsum([0] + [len(x) for _, x in parts])
    last = np.flatnonzero(np.frombuffer(packed, np.uint8) < 128)
    return [d for d, _ in parts], unpacked(packed), np.diff(np.searchsorted(last, ends))


def framed(data: list[bytes]) -> list[bytes]:
    """Each record with its lengths and checksums around it."""
    heads = [struct.pack("<Q", len(x)) for x in data]
    sums = crc32c.masked(crc32c.checksums([*heads, *data]))
    return [h + struct.pack("<I", a) + x + struct.pack("<I", b) for h, x, a, b in zip(heads, data, sums[: len(data)].tolist(), sums[len(data) :].tolist(), strict=True)]


def unframed(frames: list[bytes], where: str) -> list[bytes]:
    """The data of frames, checked."""
    heads, data = [x[:8] for x in frames], [x[12:-4] for x in frames]
    told = np.array([struct.unpack_from("<I", x, 8)[0] for x in frames] + [struct.unpack_from("<I", x, len(x) - 4)[0] for x in frames], np.uint32)
    if (crc32c.masked(crc32c.checksums([*heads, *data])) != told).any() or any(struct.unpack("<Q", h)[0] != len(x) for h, x in zip(heads, data, strict=True)):
        raise ValueError(f"a record's checksum is wrong in {where}")
    return data


# ---- files


def write(docs: DataFrame, tokenizer_json: str, end: int = END, path: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the records of docs (doc_id, text) in ascending doc_id order; the index: INDEX, stored. Files follow each other by name."""
    spark = docs.sparkSession
    bounded_batches(spark, f"{CHUNK}b")
    folder = path or scratch(spark)
    sent = spark.sparkContext.broadcast(tokenizer_json)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ["doc_id", F.xxhash64("text")]
    files = max(math.ceil(total / file_bytes), min(spark.sparkContext.defaultParallelism, math.ceil(total / (1 << 20))), 1)
    rows = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, offset, record, before = _encoder(sent.value), None, 0, 0, 0
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tfrecord"
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, ids, n in encoded(encoder, batch.column(1), end):
                packed, sizes = varints(ids)
                ends = np.cumsum(n)
                bounds = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], ends])]
                data = [example(d, packed[x:y]) for d, x, y in zip(doc_ids[a : a + len(n)], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                frames = framed(data)
                if out is None:
                    store, base = store_of(folder)
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}")
                out.write(b"".join(frames))
                size = np.array([len(x) for x in frames], np.int64)
                columns = [pa.array(doc_ids[a : a + len(n)], pa.int64()), pa.array([f"{folder}/{name}"] * len(n)), pa.array(np.arange(record, record + len(n))), pa.array(offset + np.cumsum(size) - size), pa.array(size), pa.array(before + ends - n), pa.array(n)]
                record, offset, before = record + len(n), offset + int(size.sum()), before + int(n.sum())
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "file", "record", "offset", "size", "before", "n_tokens"])
        if out is not None:
            out.close()

    return stored(rows.mapInArrow(lambda x: H.tidied(work(x)), INDEX))


def _records(frames: list[bytes], file: list[str], record: list[int], before: list[int]) -> pa.RecordBatch:
    doc_ids, found, n = parsed(unframed(frames, file[0]))
    offsets = np.concatenate([[0], np.cumsum(n * 4)]).astype(np.int64)
    ids = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(found))]).cast(pa.binary())
    arrays = [pa.array(doc_ids, pa.int64()), pa.array(file), pa.array(record, pa.int64()), pa.array(before, pa.int64()), ids]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "file", "record", "before", "ids"])


def read(files: DataFrame) -> DataFrame:
    """RECORD: the records of files (a column file), one file after the other; before: ids of the file's records before this one.

    Needs no index: frames tell their lengths. ids are little-endian unsigned 32-bit integers. A task reads the files of its partition in turn.
    """
    bounded_batches(files.sparkSession)

    def take(source, n: int, name: str) -> bytes:
        got = source.read(n)
        if len(got) < n:
            raise ValueError(f"{name} ends within a record")
        return got

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, base = store_of(name)
                with store.open_input_stream(base, buffer_size=1 << 20) as source:
                    frames, held, record, before = [], 0, 0, 0
                    while True:
                        if head := source.read(8):
                            head += take(source, 12 - len(head), name)
                            frames.append(head + take(source, struct.unpack_from("<Q", head)[0] + 4, name))
                            held += len(frames[-1])
                        if frames and (not head or held >= CHUNK):
                            n = len(frames)
                            out = _records(frames, [name] * n, [*range(record, record + n)], [0] * n)
                            many = np.diff(H.buffers(out.column(4))[1]) // 4
                            yield out.set_column(3, "before", pa.array(before + np.cumsum(many) - many))
                            record, before, frames, held = record + n, before + int(many.sum()), [], 0
                        if not head:
                            break

    return files.select("file").mapInArrow(lambda x: H.tidied(work(x)), RECORD)


def read_shuffled(index: DataFrame, seed: int, task_bytes: int = FILE_BYTES) -> DataFrame:
    """RECORD with place: all records by the index, in an order drawn by seed: tasks take ranges of the order and read by offsets."""
    spark = index.sparkSession
    bounded_batches(spark)
    total = index.agg(F.sum("size")).first()[0] or 0
    keyed = index.select(F.xxhash64(F.lit(seed), "file", "record").alias("place"), "file", "record", "before", "offset", "size")
    drawn = keyed.repartitionByRange(max(1, math.ceil(total / task_bytes)), "place", "file", "record").sortWithinPartitions("place", "file", "record")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pdf = batch.to_pandas()
            part = pdf["size"].cumsum() // CHUNK
            for _, own in pdf.groupby(part):
                frames: dict[int, bytes] = {}
                for name, of_file in own.sort_values(["file", "offset"]).groupby("file"):
                    store, base = store_of(name)
                    with store.open_input_file(base) as source:
                        for i, offset, size in zip(of_file.index, of_file["offset"], of_file["size"], strict=True):
                            frames[i] = source.read_at(size, offset)
                out = _records([frames[i] for i in own.index], own["file"].tolist(), own["record"].tolist(), own["before"].tolist())
                yield out.append_column("place", pa.array(own["place"]))

    return drawn.mapInArrow(lambda x: H.tidied(work(x)), f"{RECORD}, place long")


def file_starts(files: DataFrame) -> DataFrame:
    """file, first: ids of all files before, by name. files: a row a file, with its n_tokens."""
    return files.select("file", (F.sum("n_tokens").over(W.orderBy(F.substring_index("file", "/", -1))) - F.col("n_tokens")).alias("first"))


def default_tokenizer() -> str:
    import public_tokenizers as p

    with open(p.path(VOCABULARY), encoding="utf-8") as f:
        return f.read()


def written_and_read(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each record, from the files."""
    index = write(docs, default_tokenizer())
    files = stored(index.select("file").distinct())
    found = stored(read(files.repartition(max(1, files.count()))).select("doc_id", "file", "before", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")))
    first = file_starts(found.groupBy("file").agg(F.sum("n_tokens").alias("n_tokens")))
    return found.join(first, "file").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op12_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op12_token_records": op12_token_records}
SQL: dict[str, str] = {}
