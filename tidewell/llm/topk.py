"""Exact top-k search by dual trees: cover trees over queries and over data, traversed together.

Rows are dealt by hash to parts of PART rows at most (or PART_BYTES), queries to groups of GROUP; both get a cover tree (numpy), which
is built once, in its own task, and stored. Groups go to the parts in rounds: a round's trees (ROUND_BYTES) are broadcast, each task takes
its parts through all of them and keeps the k best of each query, so that later parts meet higher bounds. No row is copied to a
group and no query to a part; what is sent grows with the queries alone. Pairs of nodes are pruned by the covering radii, from the roots on:
no product of a query within rq of cq and a vector within rr of cr exceeds cq.cr + |cq| rr + |cr| rq + rq rr, and a pair goes when that is below the worst
kth score of the query node. Every query starts with the kth score it has in a bounded sample of SAMPLE rows, a lower bound
that prunes from the first pair on. The k best of each task meet again in a window whose limit Spark applies before its shuffle.

Every query must meet every part, in blocks: that is the stated query set against all rows. Products are exact integers.

Defined cases: vectors that are null or hold null or non-finite components (also once scaled) take no part, nor do rows without an id; vectors
of another length than the query's are no candidates; rows that repeat id and vector count once; of several vectors with one
id the best score stands; ties go to the smaller id; scores beyond a long stop at its ends; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.session import bounded_batches, stored

PART, GROUP, SAMPLE = 4096, 1024, 2048
PART_BYTES, ROUND_BYTES = 8 << 20, 64 << 20
LEAF, FAN = 24, 64
BLOCK = 16  # leaves of data multiplied at once
LONG = 2**63 - 1


class CoverTree:
    """Each node: a center, its covering radius, and children whose centers lie more than half that radius apart (FAN at most)."""

    def __init__(self, x: np.ndarray):
        self.x, self.center, self.radius, self.children, self.points = x, [], [], [], []
        with np.errstate(over="ignore", invalid="ignore"):
            self._add(np.arange(len(x)), 0, np.sqrt(((x - x[0]) ** 2).sum(1)))
        self.radius = np.array(self.radius)
        self.center = np.array(self.center)
        with np.errstate(over="ignore"):
            self.norm = np.sqrt((x[self.center] ** 2).sum(1))

    def _add(self, own: np.ndarray, center: int, dist: np.ndarray) -> int:
        node = len(self.center)
        self.center.append(center)
        self.radius.append(float(dist.max()) * (1 + 1e-9))
        self.children.append([])
        self.points.append(own)
        if len(own) <= LEAF or self.radius[node] == 0 or not math.isfinite(self.radius[node]):
            return node
        x, near, side, centers = self.x[own], dist.copy(), np.zeros(len(own), dtype=int), [center]
        while len(centers) < FAN and near.max() > self.radius[node] / 2:
            far = int(near.argmax())
            d = np.sqrt(((x - x[far]) ** 2).sum(1))
            closer = d < near
            near[closer], side[closer] = d[closer], len(centers)
            centers.append(int(own[far]))
        self.children[node] = [self._add(own[side == k], c, near[side == k]) for k, c in enumerate(centers) if (side == k).any()]
        return node


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integral rows: floats while they hold them, else Python's integers, cut to a long."""
    with np.errstate(over="ignore"):
        most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2**53:
        return a @ b.T
    ints = np.array([[int(v) for v in r] for r in a], dtype=object).reshape(a.shape) @ np.array([[int(v) for v in r] for r in b], dtype=object).reshape(b.shape).T
    return np.clip(ints, -LONG - 1, LONG)


class Asked:
    """A group of queries: tree, ids, and the best so far of each; floors: a lower bound of each one's kth score overall."""

    def __init__(self, tree: CoverTree, ids: np.ndarray, floors: np.ndarray):
        self.tree, self.ids = tree, ids
        self.top = [(np.empty(0), np.empty(0, dtype=np.int64)) for _ in ids]
        self.worst = np.where(np.isfinite(floors), floors, -np.inf).astype(float)

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
        """Rows that may be among the k best of query i; of several with one id the best counts."""
        s, v = np.concatenate([self.top[i][0], scores]), np.concatenate([self.top[i][1], ids])
        order = np.lexsort((v, -s))
        if len({*v[order[:k]].tolist()}) < min(k, len(order)):  # an id stands there twice
            order = order[np.sort(np.unique(v[order], return_index=True)[1])]
        order = order[:k]
        self.top[i] = s[order], v[order]
        if len(order) == k:
            kth = s[order[-1]]
            low = float(kth)
            self.worst[i] = max(self.worst[i], low if low <= kth else np.nextafter(low, -np.inf))


def search(asked: Asked, dt: CoverTree, ids: np.ndarray, k: int) -> None:
    """Take the rows of a tree of data into the k best of each query (ties to smaller ids), own id left out."""
    qt, query_ids, worst = asked.tree, asked.ids, asked.worst
    queries, data = qt.x, dt.x
    centers = data[dt.center]

    def bounds(q: int, nodes: np.ndarray) -> np.ndarray:
        c = queries[qt.center[q]]
        with np.errstate(over="ignore", invalid="ignore"):
            norm, rq, rr = np.sqrt((c * c).sum()), qt.radius[q], dt.radius[nodes]
            exact = centers[nodes] @ c
            out = exact + norm * rr + dt.norm[nodes] * rq + rq * rr + 1e-9 * (np.abs(exact) + norm * dt.norm[nodes] + 1)
        return np.where(np.isnan(out), np.inf, out)  # what overflows prunes nothing

    def leaf(q: int, nodes: np.ndarray) -> None:
        own = qt.points[q]
        heap = [(-b, int(n)) for b, n in zip(bounds(q, nodes), nodes, strict=True)]
        heapq.heapify(heap)
        while heap:
            block: list[np.ndarray] = []
            low = worst[own].min()
            while heap and len(block) < BLOCK:
                b, n = heapq.heappop(heap)
                if -b < low:
                    heap = []
                elif dt.children[n]:
                    below = np.array(dt.children[n])
                    for c, v in zip(below, bounds(q, below), strict=True):
                        if v >= low:
                            heapq.heappush(heap, (-v, int(c)))
                else:
                    block.append(dt.points[n])
            if not block:
                break
            at = np.concatenate(block)
            scores = products(queries[own], data[at])
            for i, row in zip(own, scores, strict=True):
                hit = (row >= worst[i]) & (ids[at] != query_ids[i])
                if hit.any():
                    asked.add(i, row[hit], ids[at][hit], k)

    def dual(q: int, nodes: np.ndarray) -> None:
        nodes = nodes[bounds(q, nodes) >= worst[qt.points[q]].min()]
        if not len(nodes):
            return
        if not qt.children[q]:
            leaf(q, nodes)
            return
        wide = [n for n in nodes if dt.children[n] and dt.radius[n] >= qt.radius[q]]
        if wide:
            nodes = np.array([*(n for n in nodes if n not in {*wide}), *(c for n in wide for c in dt.children[n])])
        for c in qt.children[q]:
            dual(c, nodes)

    dual(0, np.array([0]))


def scaled(vectors: pd.Series) -> np.ndarray:
    return np.floor(1024.0 * np.array([np.asarray(v, dtype=np.float64) for v in vectors]))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * F.lit(1024.0) < float("inf")))


def planted(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row: the tree of a part, with ids and floors (if any), as bytes."""
    tree = (CoverTree(scaled(pdf["v"])), pdf["vec_id"].to_numpy(), pdf["floor"].to_numpy() if "floor" in pdf else None)
    return pd.DataFrame({"d": pdf["d"].iloc[:1].astype("int32"), "part": pdf["part"].iloc[:1].astype("int32"), "tree": [pickle.dumps(tree, protocol=5)]})


def one_round(spark: SparkSession, data: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: for each task its k best rows for each query of a round. Stored, so that the round's trees can go."""
    sent = spark.sparkContext.broadcast([(r["d"], bytes(r["tree"])) for r in queries.select("d", "tree").collect()])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked: list[tuple[int, Asked]] = []
        for pdf in batches:
            for d, blob in zip(pdf["d"], pdf["tree"], strict=True):
                asked = asked or [(size, Asked(*pickle.loads(one))) for size, one in sent.value]
                tree, ids, _ = pickle.loads(blob)
                for size, group in asked:
                    if size == d:
                        search(group, tree, ids, k)
        for _, group in asked:
            n = [len(v) for _, v in group.top]
            if sum(n):
                scores = [int(x) for s, _ in group.top for x in s]
                yield pd.DataFrame({"query_id": np.repeat(group.ids, n), "vec_id": np.concatenate([v for _, v in group.top]), "score": scores})

    out = stored(data.select("d", "tree").mapInPandas(work, "query_id long, vec_id long, score long"))
    sent.destroy()
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of the largest inner product for each row for which is_query holds."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), is_query.alias("q"))
    rows = stored(rows.where(F.col("vec_id").isNotNull() & F.coalesce(usable(F.col("v")), F.lit(False))).dropDuplicates(["vec_id", "v"]))
    size = (F.size("v") + 2) * 8
    n, n_bytes, n_queries, query_bytes = (x or 0 for x in rows.agg(F.count("*"), F.sum(size), F.count_if("q"), F.sum(F.when(F.col("q"), size))).first())
    parts, groups = (max(1, math.ceil(many / most), math.ceil(size_ / PART_BYTES)) for many, most, size_ in ((n, PART, n_bytes), (n_queries, GROUP, query_bytes)))
    rounds = min(groups, max(1, math.ceil(query_bytes / ROUND_BYTES)))
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(5))).limit(SAMPLE).select("vec_id", "v").toPandas().drop_duplicates("vec_id")
    some, some_ids = sample["v"], sample["vec_id"].to_numpy()

    def with_floor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_length = {size: np.array([len(v) == size for v in some]) for size in {len(v) for v in some}}
        for pdf in batches:
            out = np.full(len(pdf), -np.inf)
            lengths = pdf["v"].map(len).to_numpy()
            for size in {*lengths}:
                mine, other = np.flatnonzero(lengths == size), by_length.get(size)
                if other is None or other.sum() <= k:
                    continue
                scores = products(scaled(pdf["v"].iloc[mine]), scaled(some[other])).astype(float)
                scores[pdf["vec_id"].to_numpy()[mine, None] == some_ids[other][None, :]] = -np.inf
                out[mine] = np.partition(scores, -k, axis=1)[:, -k]
            yield pdf.assign(floor=np.nextafter(out, -np.inf))

    def dealt(df: DataFrame, seed: int, into: int) -> DataFrame:
        """A tree for each of so many parts, and each length of vectors: d, part, tree."""
        keyed = df.withColumns({"d": F.size("v"), "part": F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.lit(into)).cast("int")})
        return stored(keyed.repartition(min(into, max(2000, into // 16)), "d", "part").groupBy("d", "part").applyInPandas(planted, "d int, part int, tree binary"))

    data = dealt(rows.select("vec_id", "v"), 2, parts)
    queries = rows.where("q").select("vec_id", "v").mapInPandas(with_floor, "vec_id long, v array<double>, floor double")
    queries = dealt(queries, 1, groups)
    found = [one_round(spark, data, queries.where(F.pmod("part", F.lit(rounds)) == r), k) for r in range(rounds)]
    found = reduce(DataFrame.union, found)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 100 == 0)


QUERIES = {"op3_topk": op3_topk}
SQL = {
    "op3_topk": """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, max(list_dot_product(q.e, d.e)::BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id AND len(q.e) = len(d.e)
  GROUP BY ALL),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
}
