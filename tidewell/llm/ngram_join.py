"""N-gram Jaccard join: documents whose sets of word 5-grams have a Jaccard index of 0.75 or more, and their components.

The index is a count-vector R-tree: a document's shingles are hashed to groups, its point has the number of shingles in
each group, a node of the tree has the largest number of each group below it. No two documents below two nodes share more shingles than the sum over
the groups of the smaller number; a pair of nodes or documents goes when that is too little for its sizes, and the pairs that
are left are verified by their sets.

In a large corpus nearly all points are far from each other in none of few groups, so trees are built over families of
documents which alone can be linked, found without comparing pairs:

1. Documents with the same set are one class, represented by one row.
2. A linked document shares three quarters of its shingles with another; each batch asks which of its shingles stand in other batches
   (and roughly in how many), and drops the documents with fewer.
3. Of a document with s shared shingles, t of which a link needs, the s - t + 1 rarest are its keys: linked documents have a
   key in common. Families are the components of documents and keys; a key links its documents in a star, not in pairs.
4. A family is one piece of work, with a tree of its own. A large one is cut by bands of set size (linked sizes differ by a third at most) and salt into
   blocks; each pair of blocks of equal or neighbouring bands is a piece. Documents already in one component aren't compared again.

Pieces give links that span what they have found, and the components of those are the result; near_pairs() gives every link.

Defined cases: A-Z are lower-cased; a text of 1 to 4 words has its whole sequence as its one shingle; null texts and texts
without words have an empty set and are linked with nothing (component_id is their own doc_id); null doc_ids are left out of
a component's smallest id unless it has no other; repeated rows are in one component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm import hashing as H
from tidewell.llm.batches import Batch, Named, Table
from tidewell.llm.components import components
from tidewell.session import stored

WIDTH = 5
#: The least Jaccard index, in hundredths.
NEAR = 75
LEAF = 32
#: A block's weight: shingles, and so many more for each document.
BLOCK, LEAST = 3_000_000, 2000
#: From so many batches on a shingle counts as more frequent.
LEVELS = (2, 4, 16, 64)
#: Width of the bands of set sizes: a little over 100 / NEAR.
BAND = 1.35


def needed(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of n shares with any that it is linked to."""
    return (NEAR * n + 99) // 100


class Sets:
    """Sets of a batch's texts: names of shingles in order of text and name, their texts, and each text's number of them."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        low, rows = H.lowered(raw), len(offsets) - 1
        starts, ends, doc = H.words(low, offsets)
        rolling = H.Rolling(H.span_hashes(low, starts, ends, seed=5))
        n = max(len(doc) - WIDTH + 1, 0)
        at = np.flatnonzero(doc[:n] == doc[WIDTH - 1 : WIDTH - 1 + n])
        words = np.bincount(doc, minlength=rows)
        few = np.flatnonzero((words > 0) & (words < WIDTH))
        first = np.searchsorted(doc, few)
        names = np.concatenate([rolling.windows(WIDTH)[at], rolling.spans(first, first + words[few])])
        of = np.concatenate([doc[at], few])
        order = np.lexsort((names, of))
        names, of = names[order], of[order]
        new = np.ones(len(of), bool)
        new[1:] = (names[1:] != names[:-1]) | (of[1:] != of[:-1])
        self.names, self.of = names[new], of[new]
        self.n = np.bincount(self.of, minlength=rows).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.n)])

    def digests(self) -> list[np.ndarray]:
        """Two 64-bit hashes of each set, whatever its order."""
        out = []
        for seed in (0x51, 0x52):
            sums = np.zeros(len(self.names) + 1, np.uint64)
            np.cumsum(H.mixed(self.names ^ np.uint64(seed * H.BASE & (1 << 64) - 1)), out=sums[1:])
            out.append((sums[self.begin[1:]] - sums[self.begin[:-1]]).view(np.int64))
        return out

    def among(self, rows: np.ndarray) -> np.ndarray:
        """Which names belong to these texts."""
        keep = np.zeros(len(self.n), bool)
        keep[rows] = True
        return keep[self.of]


def in_batches(lists: list[tuple[int, list[Named]]]) -> Iterator[tuple[int, np.ndarray]]:
    """A plane for each of LEVELS: so many batches have the name."""
    known, often = np.unique(np.concatenate([x[0][0] for _, x in lists]), return_counts=True)
    for number, x in lists:
        have = often[np.searchsorted(known, x[0][0])]
        yield number, np.stack([have >= level for level in LEVELS])


CANDIDATE = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("names", T.BinaryType())])


def candidates(batch: Batch) -> list[pa.Array]:
    """Rows that may be linked to another: number, size, keys, names."""
    sets = Sets(batch.raw, batch.offsets)
    own = sets.among(batch.picked)
    names, of = sets.names[own], sets.of[own]
    distinct, place, often = np.unique(names & batch.mask, return_inverse=True, return_counts=True)
    planes = batch.bits[0].reshape(len(LEVELS), -1) if len(distinct) else np.zeros((len(LEVELS), 0), bool)
    shared, level = (planes[0] | (often > 1))[place], planes.sum(0)[place]
    size, need = sets.n, needed(sets.n)
    have = np.bincount(of[shared], minlength=len(size))
    may = (have >= need) & (size > 0)
    may &= np.isin(np.arange(len(size)), batch.picked)
    rows = np.flatnonzero(may)
    keep = shared & may[of]
    s_names, s_of = names[keep], of[keep]
    order = np.lexsort((s_names, level[keep], s_of))
    s_names, s_of = s_names[order], s_of[order]
    nth = np.arange(len(s_of)) - np.searchsorted(s_of, s_of)
    key = nth < (have - need + 1)[s_of]
    at = np.concatenate([[0], np.cumsum(np.bincount(s_of[key], minlength=len(size))[rows])]).astype(np.int32)
    keys = pa.ListArray.from_arrays(pa.array(at), pa.array(s_names[key].view(np.int64)))
    whole = [sets.names[sets.begin[r] : sets.begin[r + 1]].tobytes() for r in rows]
    return [pa.array(batch.number + rows), pa.array(size[rows]), keys, pa.array(whole, pa.binary())]


class CountTree:
    """R-tree of count vectors, loaded by halving along the group whose counts differ most. Nodes: points, children, upper corner, sizes."""

    def __init__(self, points: np.ndarray, n: np.ndarray, own: np.ndarray):
        self.own, self.points, self.n = own, points, n
        self.top, self.low, self.high = points[own].max(0), n[own].min(), n[own].max()
        self.children: list[CountTree] = []
        if len(own) > LEAF:
            mine = points[own]
            spread = mine.max(0) - mine.min(0)
            axis = n[own] if self.high * NEAR > 100 * self.low or not spread.any() else mine[:, spread.argmax()]
            order = own[np.argsort(axis, kind="stable")]
            self.children = [CountTree(points, n, part) for part in (order[: len(own) // 2], order[len(own) // 2 :])]


def enough(bound: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of a and b shingles that share at most bound may be linked."""
    return ((100 + NEAR) * bound >= NEAR * (a + b)) & (100 * np.minimum(a, b) >= NEAR * np.maximum(a, b))


class Piece:
    """Sets that are compared with each other (or the first side's with the second's). every: find all links, not only spanning ones."""

    def __init__(self, sets: list[np.ndarray], every: bool = False):
        self.sets, self.every = sets, every
        self.n = np.array([len(s) for s in sets], np.int64)
        groups = 1 << int(np.clip(np.ceil(np.log2(2 * np.median(self.n))), 6, 10))
        self.points = np.zeros((len(sets), groups), np.int32)
        for row, s in zip(self.points, sets, strict=True):
            row += np.bincount((s >> np.uint64(13)).astype(np.int64) & (groups - 1), minlength=groups).astype(np.int32)
        self.component = np.arange(len(sets))
        self.links: list[tuple[int, int]] = []

    def compare(self, i: int, others: np.ndarray) -> None:
        """Link i with those of others that are near enough and, unless every link is asked for, not yet in its component."""
        if not self.every:
            others = others[self.component[others] != self.component[i]]
        if not len(others):
            return
        bound = np.minimum(self.points[others], self.points[i]).sum(1)
        others = others[enough(bound, self.n[i], self.n[others])]
        if not len(others):
            return
        mine, theirs = self.sets[i], np.concatenate([self.sets[j] for j in others])
        hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
        both = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(self.n[others])[:-1]]))
        near = 100 * both >= NEAR * (self.n[i] + self.n[others] - both)
        if self.every:
            self.links += [(i, int(j)) for j in others[near]]
            return
        for j in others[near]:
            if self.component[j] != self.component[i]:
                self.links.append((i, int(j)))
                self.component[self.component == self.component[j]] = self.component[i]

    def join(self, first: np.ndarray, second: np.ndarray | None) -> None:
        """Self-join of first, or join of first with second, by descending both trees together."""
        a = CountTree(self.points, self.n, first)
        todo = [(a, a if second is None else CountTree(self.points, self.n, second))]
        while todo:
            x, y = todo.pop()
            if 100 * x.high < NEAR * y.low or 100 * y.high < NEAR * x.low or (100 + NEAR) * int(np.minimum(x.top, y.top).sum()) < NEAR * int(x.low + y.low):
                continue
            if x is y:
                if x.children:
                    left, right = x.children
                    todo += [(left, right), (left, left), (right, right)]
                else:
                    for k, i in enumerate(x.own):
                        self.compare(int(i), x.own[k + 1 :])
            elif x.children and (len(x.own) >= len(y.own) or not y.children):
                todo += [(c, y) for c in x.children]
            elif y.children:
                todo += [(x, c) for c in y.children]
            else:
                for i in x.own:
                    self.compare(int(i), y.own)


def linked(pdf: pd.DataFrame, every: bool = False) -> pd.DataFrame:
    """Links of a piece of work that span its components, or every one."""
    piece = Piece([np.frombuffer(x, np.uint64) for x in pdf["names"]], every)
    side = pdf["side"].to_numpy()
    if pdf["self"].iloc[0]:
        piece.join(np.arange(len(pdf)), None)
    elif side.min() != side.max():
        piece.join(np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    keys = pdf["key"].to_numpy()
    return pd.DataFrame({"a": keys[[i for i, _ in piece.links]], "b": keys[[j for _, j in piece.links]]}, dtype="int64")


def pieces(found: DataFrame, families: DataFrame) -> DataFrame:
    """found (candidates) by families (node, label) as pieces of work: unit, self, side, key, names."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BAND))).cast("int")
    sizes = families.join(found.select("key", "n"), F.col("node") == F.col("key")).select("key", "n", "label", band.alias("band"))
    by_band = sizes.groupBy("label", "band").agg(F.sum(F.col("n") + LEAST).alias("weight"))
    by_family = by_band.groupBy("label").agg(
        F.sum("weight").alias("weight"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("weight") / BLOCK).cast("int").alias("blocks")))).alias("blocks")
    )
    placed = sizes.join(by_family, "label")
    at = lambda off: F.element_at("blocks", F.col("band") + off)
    salt = F.pmod(F.xxhash64("key", F.lit(31)), at(0)).cast("int")
    count = lambda n: F.sequence(F.lit(0), n - 1)
    unit = lambda b1, s1, b2, s2, side: F.struct(b1.alias("b1"), s1.alias("s1"), b2.alias("b2"), s2.alias("s2"), side.cast("int").alias("side"))
    none, here = F.lit(0), F.col("band")
    nothing = F.array().cast("array<struct<b1:int,s1:int,b2:int,s2:int,side:int>>")
    cut = F.concat(
        F.transform(count(at(0)), lambda q: unit(here, F.least(salt, q), here, F.greatest(salt, q), (salt > q).cast("int"))),
        F.when(at(1).isNotNull(), F.transform(count(at(1)), lambda q: unit(here, salt, here + 1, q, none))).otherwise(nothing),
        F.when(at(-1).isNotNull(), F.transform(count(at(-1)), lambda q: unit(here - 1, q, here, salt, F.lit(1)))).otherwise(nothing),
    )
    units = F.when(F.col("weight") <= BLOCK, F.array(unit(none, none, none, none, none))).otherwise(cut)
    dealt = placed.select("key", "label", units.alias("units")).join(found.select("key", "names"), "key").select("key", "names", "label", F.explode("units").alias("u"))
    same = (F.col("u.b1") == F.col("u.b2")) & (F.col("u.s1") == F.col("u.s2"))
    return dealt.select(F.struct("label", "u.b1", "u.s1", "u.b2", "u.s2").alias("unit"), same.alias("self"), F.col("u.side").alias("side"), "key", "names")


def find_links(table: Table, classes: DataFrame, every: bool = False) -> DataFrame:
    """a, b: links between representatives (key, batch of classes) that span the components, or every link, once."""
    table.pick(classes.select("batch", "key"))

    def shingled(batch: Batch) -> list[Named]:
        sets = Sets(batch.raw, batch.offsets)
        return [(np.unique(sets.names[sets.among(batch.picked)] & batch.mask), None)]

    table.ask(shingled, in_batches)
    found = stored(table.rows(candidates, CANDIDATE))
    keyed = found.select("key", F.explode("keys").alias("name"))
    star = keyed.groupBy("name").agg(F.min("key").alias("hub"), F.count("*").alias("often")).where("often > 1").select("name", "hub")
    families = stored(components(keyed.join(star, "name").where("key <> hub").select("key", "hub").distinct()))
    return stored(pieces(found, families).groupBy("unit").applyInPandas(lambda pdf: linked(pdf, every), "a long, b long"))


INFO = T.StructType([T.StructField(c, T.LongType()) for c in ("batch", "key", "id", "n", "h1", "h2")])


def described(table: Table, id_at: int) -> DataFrame:
    """batch, key, id, n, h1, h2 of every row: where it is, its id, the size and two hashes of its set."""

    def work(batch: Batch) -> list[pa.Array]:
        sets, rows = Sets(batch.raw, batch.offsets), len(batch.offsets) - 1
        return [pa.array(np.full(rows, batch.number)), pa.array(batch.number + np.arange(rows)), batch.columns[id_at].cast(pa.int64()), pa.array(sets.n), *map(pa.array, sets.digests())]

    return stored(table.rows(work, INFO))


def equal_sets(info: DataFrame) -> DataFrame:
    """Classes of equal sets: h1, h2, key and batch of the representative, least (id), rows."""
    classes = info.where("n > 0").groupBy("h1", "h2").agg(F.min(F.struct("key", "batch")).alias("r"), F.min("id").alias("least"), F.count("*").alias("rows"))
    return stored(classes.select("h1", "h2", "r.key", "r.batch", "least", "rows"))


def by_class(info: DataFrame, table: Table) -> DataFrame:
    """Classes of equal sets: h1, h2, key and batch of the representative, component (the representative's key where nothing links)."""
    classes = equal_sets(info)
    labels = components(find_links(table, classes))
    out = classes.join(labels, classes["key"] == labels["node"], "left")
    return stored(out.select("h1", "h2", "key", "batch", "least", F.coalesce("label", "key").alias("component")))


def near_pairs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """All links, copies not expanded: (class_a, class_b: each linked pair of classes of equal sets once) and membership (doc_id, class, n_links).

    A row's n_links counts every other row that it is linked to, those with an equal set included. Rows with an empty set have no class and no links.
    Each linked pair is verified, so the work follows their number; near_duplicates() gives components without that.
    """
    table = Table(docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")), "text", ["id"])
    info = described(table, 0)
    classes = equal_sets(info)
    pairs = find_links(table, classes, every=True).select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"))
    both = pairs.union(pairs.select("class_b", "class_a")).toDF("key", "other")
    sizes = classes.select(F.col("key").alias("other"), F.col("rows").alias("n_other"))
    beyond = both.join(sizes, "other").groupBy("key").agg(F.sum("n_other").alias("beyond"))
    counted = classes.join(beyond, "key", "left").select("h1", "h2", F.col("key").alias("class"), (F.col("rows") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"))
    members = info.where("n > 0").join(counted, ["h1", "h2"]).select("id", "class", "n_links")
    members = members.union(info.where("n = 0").select("id", F.lit(None).cast("long"), F.lit(0).cast("long")))
    return pairs, members.withColumnRenamed("id", doc_id)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    table = Table(docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")), "text", ["id"])
    info = described(table, 0)
    classes = by_class(info, table)
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "component").select("h1", "h2", "component_id", F.lit(True).alias("linked"))
    out = info.where("n > 0").join(named, ["h1", "h2"], "left").select("id", "n", "component_id")
    out = out.union(info.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id")


def representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (null last). Rows with an empty set all stay."""
    carry = [c for c in docs.columns if c != text]
    table = Table(docs, text, carry)
    info = described(table, carry.index(doc_id))
    classes = by_class(info, table)
    joined = info.where("n > 0").join(classes.select("h1", "h2", "component"), ["h1", "h2"])
    order = F.struct(F.col("id").isNull().alias("late"), "id", "key", "batch")
    best = joined.groupBy("component").agg(F.min(order).alias("b")).select("b.batch", "b.key")
    table.bits = []
    table.pick(best.union(info.where("n = 0").select("batch", "key")))
    schema = T.StructType([*table.fields, T.StructField("_text", T.BinaryType()), T.StructField("_null", T.BooleanType())])

    def work(batch: Batch) -> list[pa.Array]:
        texts = [batch.raw[batch.offsets[r] : batch.offsets[r + 1]].tobytes() for r in batch.picked]
        rows = pa.array(batch.picked)
        return [*(c.take(rows) for c in batch.columns), pa.array(texts, pa.binary()), batch.nulls.take(rows)]

    out = table.rows(work, schema)
    return out.withColumn(text, F.when(~F.col("_null"), F.col("_text").cast("string"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op5_ngram_join": op5_ngram_join}
SQL = {
    "op5_ngram_join": r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS (
  SELECT DISTINCT k, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT k, count(*) AS n FROM g GROUP BY k),
o AS (SELECT a.k AS x, b.k AS y, count(*) AS c FROM g a JOIN g b USING (s) WHERE a.k <> b.k GROUP BY a.k, b.k),
l AS (SELECT x, y FROM o JOIN n a ON a.k = x JOIN n b ON b.k = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r(k, o) AS (SELECT k, k FROM n UNION SELECT l.y, r.o FROM r JOIN l ON l.x = r.k),
m AS (SELECT r.k, min(doc_id) AS c FROM r JOIN d ON d.k = r.o GROUP BY r.k)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE c END AS component_id
FROM d LEFT JOIN n USING (k) LEFT JOIN m USING (k)
"""
}
