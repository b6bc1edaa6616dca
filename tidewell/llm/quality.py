"""Quality classifier: random-indexing word vectors pooled by document, then a two-layer network with calibrated probabilities.

Every token (run of letters and digits, or of signs) has an index vector: DIM places, SEEDS of them 1 or -1, given by its hash. A
frequent token's vector adds its context vector: the sum of the index vectors of its neighbours over the training sample.
A document is the mean of its tokens' vectors, with that mean's length (it grows as few tokens repeat) and the number of
tokens. A network of two layers (numpy, Adam) is fitted to the labels, and a temperature to a held-back fifth of the sample.

Fitting uses at most MAX_TRAIN labelled rows (by the order of a hash of their ids) and VOCABULARY frequent tokens; both bound
what the driver holds and what is broadcast. Scoring is one pass over all rows without a shuffle.

Defined cases: null and empty texts have no tokens and get the score of such a document; of several labels of one doc_id the
mean counts; null labels don't; of a labelled doc_id's several rows the smallest text is learned from; without labels of both kinds every score is the share of label 1 (0.5 without any); repeated
rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm import hashing as H
from tidewell.session import bounded_batches, stored

DIM, SEEDS = 64, 8
MAX_TRAIN, VOCABULARY = 20_000, 4096
HIDDEN, EPOCHS, RATE, BATCH = 32, 40, 3e-3, 128
THRESHOLD = 0.3
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == 0, F.lit(False))


def index_places(h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and signs of the index vectors of token hashes, one of the SEEDS at a time."""
    for j in range(SEEDS):
        yield ((h >> np.uint64(6 * j)) & np.uint64(DIM - 1)).astype(np.int64), 1.0 - 2.0 * ((h >> np.uint64(48 + j)) & np.uint64(1)).astype(np.float64)


def index_vectors(h: np.ndarray) -> np.ndarray:
    out = np.zeros((len(h), DIM))
    for place, sign in index_places(h):
        np.add.at(out, (np.arange(len(h)), place), sign)
    return out / np.sqrt(SEEDS)


def _tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = H.lowered(raw)
    starts, ends, doc = H.tokens(low, offsets)
    return H.span_hashes(low, starts, ends, seed=4), doc


def _known(h: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Number of each token in the sorted vocabulary, or -1."""
    if not len(vocabulary):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[at] == h, at, -1)


def features(raw: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray, context: np.ndarray) -> np.ndarray:
    """A row for each text: its mean vector, that vector's length, and the logarithm of its number of tokens."""
    h, doc = _tokens(raw, offsets)
    n = len(offsets) - 1
    count = np.bincount(doc, minlength=n).astype(float)
    pooled = np.zeros(n * DIM)
    for place, sign in index_places(h):
        pooled += np.bincount(doc * DIM + place, weights=sign, minlength=n * DIM)
    pooled = pooled.reshape(n, DIM) / np.sqrt(SEEDS)
    if len(vocabulary):
        known = _known(h, vocabulary)
        own = known >= 0
        often = np.bincount(doc[own] * len(vocabulary) + known[own], minlength=n * len(vocabulary)).reshape(n, -1)
        pooled += often.astype(np.float32) @ context
    pooled /= np.maximum(count, 1)[:, None]
    return np.column_stack([pooled, np.sqrt((pooled**2).sum(1)), np.log1p(count)])


class Network:
    """Two layers; fit() standardises the inputs and sets the temperature."""

    def __init__(self, base: float = 0.5):
        self.base, self.layers, self.temperature = base, None, 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.std @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))

    def fit(self, x: np.ndarray, y: np.ndarray, later: np.ndarray) -> Network:
        """later: rows held back for the temperature."""
        if not len(y):
            return self
        self.base = float(y.mean())
        if y.min() == y.max():
            return self
        fx, fy = (x[~later], y[~later]) if len({*y[~later]}) > 1 else (x, y)
        rng = np.random.default_rng(11)
        self.mean, self.std = fx.mean(0), fx.std(0) + 1e-6
        p = [rng.normal(0, fx.shape[1] ** -0.5, (fx.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.layers = p
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        z = (fx - self.mean) / self.std
        for _ in range(EPOCHS):
            order = rng.permutation(len(z))
            for a in range(0, len(z), BATCH):
                i = order[a : a + BATCH]
                hidden = np.tanh(z[i] @ p[0] + p[1])
                off = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -50, 50))) - fy[i]) / len(i)
                back = off[:, None] * p[2] * (1 - hidden**2)
                grads = [z[i].T @ back + 1e-4 * p[0], back.sum(0), hidden.T @ off + 1e-4 * p[2], off.sum(keepdims=True)]
                t += 1
                for a_, g, mi, vi in zip(p, grads, m, v, strict=True):
                    mi *= 0.9
                    mi += 0.1 * g
                    vi *= 0.999
                    vi += 0.001 * g * g
                    a_ -= RATE * (mi / (1 - 0.9**t)) / (np.sqrt(vi / (1 - 0.999**t)) + 1e-8)
        cx, cy = (x[later], y[later]) if later.any() else (fx, fy)
        out = self.logits(cx)
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 80))
        self.temperature = float(min(grid, key=lambda s: np.logaddexp(0, -(2 * cy - 1) * out / s).mean()))
        return self


class Model:
    def __init__(self, vocabulary: np.ndarray, context: np.ndarray, network: Network):
        self.vocabulary, self.context, self.network = vocabulary, context, network

    def score(self, column: pa.Array) -> np.ndarray:
        return self._all(column, lambda x: self.network.score(x), 1)

    def features(self, column: pa.Array) -> np.ndarray:
        return self._all(column, lambda x: x, DIM + 2)

    def _all(self, column: pa.Array, f, width: int) -> np.ndarray:
        parts = [f(features(raw, at, self.vocabulary, self.context)) for _, _, raw, at in H.chunks(column)]
        return np.concatenate(parts) if parts else np.zeros((0, width) if width > 1 else 0)


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_TRAIN) -> DataFrame:
    """text, y, later of at most most labelled rows, none of them held out."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(21)), "doc_id").limit(most)
    chosen = chosen.withColumn("later", F.pmod(F.xxhash64("doc_id", F.lit(22)), F.lit(5)) == 0)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # one row an id, however often its rows are repeated: what the fit gathers stays within most rows
    return joined.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"), F.first("later").alias("later"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = stored(training_rows(docs, labels, label).repartition(16, "doc_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, raw, at in H.chunks(b.column("text")):
                h, c = np.unique(_tokens(raw, at)[0].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c)], ["h", "n"])

    often = rows.select("text").mapInArrow(lambda b: H.tidied(count(b)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = often.where("n >= 5").orderBy(F.desc("n"), "h").limit(VOCABULARY).select("h").toPandas()["h"]
    vocabulary = np.sort(top.to_numpy().astype(np.int64).view(np.uint64))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(vocabulary), DIM))
        for b in batches:
            for _, _, raw, at in H.chunks(b.column("text")):
                h, doc = _tokens(raw, at)
                known = _known(h, vocabulary)
                for off in (-2, -1, 1, 2):
                    i = np.arange(max(0, -off), len(h) - max(0, off))
                    i = i[(known[i] >= 0) & (doc[i] == doc[i + off])] if len(i) else i
                    for place, sign in index_places(h[i + off]):
                        sums += np.bincount(known[i] * DIM + place, weights=sign, minlength=sums.size).reshape(sums.shape)
        yield pa.RecordBatch.from_arrays([pa.array([sums.astype(np.float32).tobytes()], pa.binary())], ["sums"])

    context = np.zeros((len(vocabulary), DIM))
    if len(vocabulary):
        for r in rows.select("text").mapInArrow(lambda b: H.tidied(neighbours(b)), "sums binary").toLocalIterator():
            context += np.frombuffer(bytes(r["sums"]), np.float32).reshape(context.shape)
        context -= context.sum(0) / max(np.abs(context).sum(), 1) * np.abs(context).sum(1, keepdims=True)
        context *= 0.5 / np.maximum(np.sqrt((context**2).sum(1, keepdims=True)), 1e-9)
    model = Model(vocabulary, context.astype(np.float32), Network())
    shared = spark.sparkContext.broadcast(model)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = shared.value.features(b.column("text")).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary()), b.column("y"), b.column("later")], ["doc_id", "x", "y", "later"])

    got = rows.mapInArrow(lambda b: H.tidied(featured(b)), "doc_id long, x binary, y int, later boolean").toPandas().sort_values(["doc_id", "x"])
    x = np.frombuffer(b"".join(map(bytes, got["x"])), np.float64).reshape(len(got), DIM + 2)
    model.network.fit(x, got["y"].to_numpy().astype(float), got["later"].to_numpy().astype(bool))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """docs with a score of every row's whole text."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([f for f in docs.schema.fields if f.name != to] + [T.StructField(to, T.DoubleType())])
    names = [f.name for f in schema.fields[:-1]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array(shared.value.score(b.column(text)).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), made], [*names, to])

    return docs.mapInArrow(lambda rows: H.tidied(work(rows)), schema)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), fit(docs, labels)).select("doc_id", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


QUERIES = {"op4_quality": op4_quality}
SQL: dict[str, str] = {}
