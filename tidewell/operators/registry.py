"""An append-only registry of entries in order of n: resolution, budgets, hash chains, collisions, extensions, group winners.

An entry has n, id, state, lot and a body; its hash covers its body and the hash of the entry before it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

GENESIS = "0" * 64


def resolve(entries: DataFrame) -> DataFrame:
    """One row an id: its entries, lot and n of the first, state and n of the last, and the last state that isn't a transition."""
    plain = F.when(F.col("state") != "P", F.col("n"))
    return entries.groupBy("id").agg(
        F.count("*").alias("entries"),
        F.min("n").alias("first_n"),
        F.max("n").alias("last_n"),
        F.min_by("lot", "n").alias("lot"),
        F.max_by("state", "n").alias("state"),
        F.max_by("state", plain).alias("plain_state"),
    )


def budget(resolved: DataFrame, most: int) -> DataFrame:
    """Ids admitted in each lot against a budget."""
    got = resolved.groupBy("lot").agg(F.count("*").alias("ids"), F.count_if(F.col("state") == "F").alias("final"))
    return got.withColumns({"left": F.lit(most) - F.col("ids"), "over": F.col("ids") > most})


def collisions(entries: DataFrame, digest: Column) -> DataFrame:
    """Digests of a field that more than one id has."""
    got = entries.withColumn("digest", digest).groupBy("digest").agg(F.count_distinct("id").alias("ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return got.where("ids > 1")


def link_hash(previous: Column, body: Column) -> Column:
    return F.sha2(F.concat_ws("|", previous, body), 256)


def chained(entries: DataFrame, by: str = "chain") -> DataFrame:
    """entries (by, n, body) with previous_hash and hash: a chain is one after another by nature; a task reads its chains in order of n and holds the last hash only."""
    picked = entries.select(by, "n", "body")
    schema = T.StructType([*picked.schema.fields, T.StructField("previous_hash", T.StringType()), T.StructField("hash", T.StringType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, last, begun = None, GENESIS, False
        for b in batches:
            before, own = [], []
            for key, body in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not begun or key != chain:
                    chain, last, begun = key, GENESIS, True
                before.append(last)
                last = hashlib.sha256("|".join(x for x in (last, body) if x is not None).encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before), pa.array(own)], [*b.schema.names, "previous_hash", "hash"])

    return picked.repartition(by).sortWithinPartitions(by, "n").mapInArrow(fold, schema)


def broken_links(chain: DataFrame, by: str = "chain") -> DataFrame:
    """Entries whose own hash or link to the entry before is wrong. A window by chain; nothing is folded."""
    before = F.coalesce(F.lag("hash").over(W.partitionBy(by).orderBy("n")), F.lit(GENESIS))
    own = F.col("hash") == link_hash(F.col("previous_hash"), F.col("body"))
    x = chain.select(by, "n", (F.col("previous_hash") == before).alias("linked"), own.alias("own"))
    return x.where(~F.col("linked") | ~F.col("own"))


def extends(old: DataFrame, new: DataFrame, by: str = "chain") -> DataFrame:
    """For each chain of old whether new continues it: every old entry is there with the same hash."""
    other = new.select(F.col(by).alias("_c"), F.col("n").alias("_n"), F.col("hash").alias("_hash"))
    j = old.join(other, (F.col(by) == F.col("_c")) & (F.col("n") == F.col("_n")), "left")
    same = F.coalesce(F.col("hash") == F.col("_hash"), F.lit(False))
    return j.groupBy(by).agg(F.count("*").alias("entries"), F.count_if(same).alias("kept")).withColumn("extends", F.col("entries") == F.col("kept"))


def canonical(value: object) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_sha(column: Column) -> Column:
    """SHA-256 of the canonical form of a JSON text; null for null or broken JSON."""

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else hashlib.sha256(canonical(json.loads(t)).encode()).hexdigest()
            except ValueError:
                return None

        return texts.map(one)

    return digest(column)


def group_winners(rows: DataFrame, group: str, value: str, tie: str) -> DataFrame:
    """The row of the largest value of each day and group, ties to the smaller tie; rows without a group all stay."""
    order = W.partitionBy("d", group).orderBy(F.desc(value), tie)
    return rows.withColumn("_i", F.row_number().over(order)).where((F.col("_i") == 1) | F.col(group).isNull()).drop("_i")


def denominators(rows: DataFrame, least: float, accredited: Column) -> DataFrame:
    """d, total, n, unaccredited share (percent) of the values of at least least; days with fewer than two are left out."""
    kept = rows.where(F.col("value") >= least)
    got = kept.groupBy("d").agg(F.sum("value").alias("total"), F.count("*").alias("n"), (100 * F.sum(F.when(~accredited, F.col("value")).otherwise(0)) / F.sum("value")).alias("unaccredited"))
    return got.where("n >= 2")


def latest_wins(history: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Upsert: rows of new replace those of history with the same key."""
    both = history.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return both.withColumn("_i", F.row_number().over(W.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(F.desc("_v")))).where("_i = 1").drop("_v", "_i")


def funnel(rows: DataFrame, by: str, stage: str, stages: list[str]) -> DataFrame:
    """Counts by stage, and of each stage's reach the share that goes on."""
    reached = [F.count_if(F.array_position(F.array(*map(F.lit, stages)), F.col(stage)) > k).alias(f"reached_{s}") for k, s in enumerate(stages)]
    got = rows.groupBy(by).agg(*reached)
    share = lambda a, b: F.round(F.col(f"reached_{b}") / F.when(F.col(f"reached_{a}") > 0, F.col(f"reached_{a}")), 6).alias(f"{a}_to_{b}")
    return got.select(by, *[f"reached_{s}" for s in stages], *[share(a, b) for a, b in zip(stages, stages[1:], strict=False)])
