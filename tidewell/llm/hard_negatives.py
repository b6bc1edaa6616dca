"""Hard negatives by branch and bound over ball trees: the best rows of another label whose score lies in a window under a positive's.

Rows are dealt by hash to parts of PART rows at most (or PART_BYTES); each part gets a ball tree in its own task, stored once. A node
has a center, the radius of the ball that holds its rows, and the least and greatest of their labels. A row x of the ball has
q.c - |q| r <= q.x <= q.c + |q| r, so a node goes where the upper bound is under a window or strictly under the current kth score, or
where the lower bound is over the window; rows of equal score are still compared by id. Trees are walked once for a whole block of anchors: each
node passes on those anchors that it may still serve, children come by falling mean bound.

Two walks: the first finds each anchor's positives (its best rows of one label), the second the negatives for each anchor and positive. Anchors
go to the parts in rounds of ROUND_BYTES, broadcast; a task takes its parts through them and gives at most k rows an anchor (or positive), which meet
in a window whose limit Spark applies before its shuffle. Every anchor must meet every part: that is the stated set against all rows.

Scores are exact integers; beyond a long they stop at its ends. Where products leave a double's exact range they are Python's integers. Bounds that
overflow prune nothing, and a ball whose radius isn't finite is not split.

Defined cases: rows without id or label, without vector, or with null or non-finite components (also once scaled) take no part; anchors meet
vectors of their own length only; of several rows with one id the one of smallest label, then vector, stands; an anchor
without positives, or whose window is empty, has no rows; a negative positive score has an empty window (half of it is more than 95 % of it);
other columns are left aside; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.topk import products
from tidewell.session import bounded_batches, stored

PART, PART_BYTES, ROUND_BYTES = 4096, 8 << 20, 32 << 20
LEAF = 48
LEAST, MOST = -(2**63) + 1, 2**63 - 1
#: So many anchors go through a tree side by side.
BLOCK = 512


class BallTree:
    """Nodes of rows x (integral doubles) with ids and labels; a node is split by its two rows that lie far apart."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.x, self.ids, self.labels = x[order], ids[order], labels[order]
        self.center, self.radius, self.least, self.greatest, self.children, self.rows = [], [], [], [], [], []
        waiting = [(np.arange(len(x)), -1)]
        while waiting:
            own, parent = waiting.pop()
            node = len(self.center)
            if parent >= 0:
                self.children[parent].append(node)
            with np.errstate(over="ignore", invalid="ignore"):
                c = self.x[own].mean(0)
                dist = np.sqrt(((self.x[own] - c) ** 2).sum(1))
            r = float(dist.max()) * (1 + 1e-9)
            for known, value in ((self.center, c), (self.radius, r), (self.least, self.labels[own].min()), (self.greatest, self.labels[own].max()), (self.children, []), (self.rows, own)):
                known.append(value)
            if len(own) <= LEAF or r == 0 or not math.isfinite(r):
                continue
            a = self.x[own[dist.argmax()]]
            from_a = ((self.x[own] - a) ** 2).sum(1)
            b = self.x[own[from_a.argmax()]]
            near = ((self.x[own] - b) ** 2).sum(1) < from_a
            if near.all() or not near.any():
                continue
            self.rows[node] = None
            waiting += [(own[near], node), (own[~near], node)]
        self.center, self.radius = np.array(self.center), np.array(self.radius)


class Best:
    """The k best of each of n askers: scores falling, ties to smaller ids; places without a row have score LEAST - 1."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), LEAST - 1, np.int64), np.full((n, k), MOST, np.int64)

    def kth(self) -> np.ndarray:
        return self.scores[:, -1]

    def take(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """Rows (a column each) that fit are offered to who (a row each)."""
        some = fits.any(1)
        who, scores, fits = who[some], scores[some], fits[some]
        if len(who):
            s = np.concatenate([self.scores[who], np.where(fits, scores, LEAST - 1)], axis=1)
            i = np.concatenate([self.ids[who], np.where(fits, ids, MOST)], axis=1)
            order = np.lexsort((i, ~s), axis=1)[:, : self.k]
            self.scores[who], self.ids[who] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


class Asked:
    """Anchors (vectors, ids, labels) and askers: for each the anchor, and the window of scores."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.x, self.ids, self.labels, self.of, self.low, self.high, self.same = x, ids, labels, of, low, high, same
        with np.errstate(over="ignore"):
            self.norm = np.sqrt((x * x).sum(1))
        self.best = Best(len(of), k)

    def through(self, tree: BallTree) -> None:
        """Take the tree's rows into the askers' best."""
        for a in range(0, len(self.of), BLOCK):
            self._walk(tree, np.arange(a, min(a + BLOCK, len(self.of))))

    def _bounds(self, tree: BallTree, node: int, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore", invalid="ignore"):
            mid, reach = self.x[anchors] @ tree.center[node], self.norm[anchors] * tree.radius[node]
            reach = reach + 1e-9 * (np.abs(mid) + self.norm[anchors] * np.sqrt((tree.center[node] ** 2).sum()) + 1)
            low, high = mid - reach, mid + reach
        return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)

    def _left(self, tree: BallTree, node: int, askers: np.ndarray) -> tuple[np.ndarray, float]:
        """Askers that a node may serve, and their mean upper bound."""
        least, greatest, label = tree.least[node], tree.greatest[node], self.labels[self.of[askers]]
        askers = askers[(least <= label) & (label <= greatest)] if self.same else askers[(least != label) | (greatest != label)]
        if not len(askers):
            return askers, 0.0
        anchors, back = np.unique(self.of[askers], return_inverse=True)
        low, high = (b[back] for b in self._bounds(tree, node, anchors))
        stays = (high >= self.low[askers]) & (low <= self.high[askers]) & (high >= self.best.kth()[askers])
        return askers[stays], float(np.clip(high[stays], -1e300, 1e300).mean()) if stays.any() else 0.0

    def _walk(self, tree: BallTree, askers: np.ndarray) -> None:
        waiting = [(0, askers)]
        while waiting:
            node, askers = waiting.pop()
            askers, _ = self._left(tree, node, askers)  # once more: their kth scores may have risen
            if not len(askers):
                continue
            if tree.rows[node] is not None:
                self._leaf(tree, tree.rows[node], askers)
                continue
            below = [(bound, c, mine) for c in tree.children[node] for mine, bound in [self._left(tree, c, askers)] if len(mine)]
            waiting += [(c, mine) for _, c, mine in sorted(below, key=lambda x: x[0])]  # the highest is taken first

    def _leaf(self, tree: BallTree, rows: np.ndarray, askers: np.ndarray) -> None:
        anchors, back = np.unique(self.of[askers], return_inverse=True)
        scores = np.clip(products(self.x[anchors], tree.x[rows]), LEAST, MOST).astype(np.int64) if len(rows) else np.zeros((len(anchors), 0), np.int64)
        scores, ids = scores[back], tree.ids[rows]
        mine = tree.labels[rows][None, :] == self.labels[self.of[askers]][:, None]
        fits = (mine == self.same) & (ids[None, :] != self.ids[self.of[askers]][:, None])
        fits &= (scores >= self.low[askers][:, None]) & (scores <= self.high[askers][:, None]) & (scores >= self.best.kth()[askers][:, None])
        self.best.take(askers, scores, ids, fits)


def scaled(vectors: pd.Series, scale: float) -> np.ndarray:
    return np.floor(scale * np.array([np.asarray(v, dtype=np.float64) for v in vectors]))


def usable(vector: Column, scale: float) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * F.lit(scale) < float("inf")))


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest score with low * score <= 100 * negative <= high * score."""
    return max(-(-low * score // 100), LEAST), min(high * score // 100, MOST)


def _asked(pdf: pd.DataFrame, scale: float, k: int, within: tuple[int, int] | None) -> Asked:
    """Anchors of one length; within: the window in hundredths of the positives' scores, None for positives."""
    x, ids, labels = scaled(pdf["v"], scale), pdf["vec_id"].to_numpy(), pdf["label"].to_numpy()
    if within is None:
        of = np.arange(len(pdf))
        return Asked(x, ids, labels, of, np.full(len(of), LEAST), np.full(len(of), MOST), True, k)
    of = np.repeat(np.arange(len(pdf)), pdf["positives"].map(len).to_numpy())
    bounds = [window(int(p["score"]), *within) for ps in pdf["positives"] for p in ps]
    low, high = (np.array([b[i] for b in bounds], np.int64) for i in (0, 1))
    return Asked(x, ids, labels, of, low, high, False, k)


def _round(spark: SparkSession, trees: DataFrame, anchors: DataFrame, scale: float, k: int, within: tuple[int, int] | None) -> DataFrame:
    """anchor_id, place (of the positive), other_id, score: each task's k best for each asker. Stored, so that the anchors can go."""
    sent = spark.sparkContext.broadcast(anchors.toPandas())

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked: dict[int, Asked] = {}
        for pdf in batches:
            for d, blob in zip(pdf["d"], pdf["tree"], strict=True):
                if not asked:
                    asked = {size: _asked(own.reset_index(drop=True), scale, k, within) for size, own in sent.value.groupby(sent.value["v"].map(len))}
                if d in asked:
                    asked[d].through(pickle.loads(blob))
        for a in asked.values():
            n, (who, at) = np.bincount(a.of, minlength=len(a.ids)), np.nonzero(a.best.scores >= LEAST)
            place = np.arange(len(a.of)) - np.repeat(np.cumsum(n) - n, n)
            yield pd.DataFrame({"anchor_id": a.ids[a.of[who]], "place": place[who].astype("int32"), "other_id": a.best.ids[who, at], "score": a.best.scores[who, at]})

    out = stored(trees.select("d", "tree").mapInPandas(work, "anchor_id long, place int, other_id long, score long"))
    sent.destroy()
    return out


def _best(spark: SparkSession, trees: DataFrame, anchors: DataFrame, n_bytes: int, scale: float, k: int, within: tuple[int, int] | None) -> DataFrame:
    rounds = max(1, math.ceil(n_bytes / ROUND_BYTES))
    in_round = lambda r: anchors.where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(rounds)) == r)
    found = reduce(DataFrame.union, [_round(spark, trees, in_round(r), scale, k, within) for r in range(rounds)])
    order = W.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, scale: float = 256.0, positives: int = 5, negatives: int = 3, within: tuple[int, int] = (50, 95)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors (vec_id, embedding, label).

    within: a negative's score must lie between these hundredths of the positive's.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"), is_anchor.alias("q"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(usable(F.col("v"), scale), F.lit(False)))
    rows = stored(rows.groupBy("vec_id").agg(F.min(F.struct("label", "v", "q")).alias("r")).select("vec_id", "r.*"))
    size = (F.size("v") + 3) * 8
    n, n_bytes, anchor_bytes = (x or 0 for x in rows.agg(F.count("*"), F.sum(size), F.sum(F.when(F.col("q"), size + 24 * positives))).first())
    parts = max(1, math.ceil(n / PART), math.ceil(n_bytes / PART_BYTES))

    def planted(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = BallTree(scaled(pdf["v"], scale), pdf["vec_id"].to_numpy(), pdf["label"].to_numpy())
        return pd.DataFrame({"d": [len(pdf["v"].iloc[0])], "tree": [pickle.dumps(tree, protocol=5)]})

    keyed = rows.select("vec_id", "v", "label", F.size("v").alias("d"), F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(parts)).alias("part"))
    dealt = keyed.repartition(min(parts, max(2000, parts // 16)), "d", "part")
    trees = stored(dealt.groupBy("d", "part").applyInPandas(planted, "d int, tree binary"))
    walk: Callable[..., DataFrame] = lambda a, k, w: _best(spark, trees, a, anchor_bytes, scale, k, w)
    anchors = rows.where("q").select("vec_id", "v", "label")
    near = walk(anchors, positives, None).groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("other_id").alias("id"), "score"))).alias("positives"))
    near = stored(near.withColumnRenamed("anchor_id", "vec_id"))
    hard = walk(anchors.join(near, "vec_id"), negatives, within)
    positive = near.select(F.col("vec_id").alias("anchor_id"), F.posexplode("positives").alias("place", "p"))
    return hard.join(positive, ["anchor_id", "place"]).select(
        "anchor_id", F.col("p.id").alias("positive_id"), "rank", F.col("other_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score")
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    noisy = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(noisy, F.col("vec_id") % 50 == 0)


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
SQL = {
    "op13_hard_negatives": """
WITH v AS (
  SELECT vec_id, min(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label, arg_min(list_transform(embedding, lambda x: floor(256 * x::DOUBLE)), label) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.e, r.e)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id AND len(a.e) = len(r.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
}
