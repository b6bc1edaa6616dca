"""Connected components of a graph of links, by alternating large stars and small stars.

Every node first points to the least node of its task's part of the graph; then, in turn, each node's larger neighbours and each node's
smaller neighbours are linked to the least of them, until nothing changes. All steps are joins and aggregates of two longs;
a node with very many links is only ever a row in them. Each round is written to the shared folder.

Defined cases: links of a node to itself and repeated links don't matter; nulls are dropped; no links give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import ship, stored


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a part of the graph with the least node that it reaches there."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    def flush() -> pa.RecordBatch:
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 1_000_000:
            yield flush()
    yield flush()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    out = both.join(least, both["a"] == least["u"]).where(F.col("b") > F.col("a"))
    return out.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    joined = down.join(least, down["a"] == least["u"])
    out = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
    return out.select("x.a", "x.b").where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: two columns of longs. node, label: every node of a link with the least node that it reaches."""
    ship(links.sparkSession)
    a, b = links.columns
    now = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    now = stored(now.mapInArrow(_forest, "a long, b long"))
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if state == seen or not state[0]:
            break
        seen, now = state, stored(_small_star(_large_star(now)))
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b")).distinct()
