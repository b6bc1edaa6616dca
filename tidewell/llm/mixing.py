"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents may belong to several sources at once. They are aggregated by membership pattern (the set of their sources); a
pattern's words are its capacity for each time over the corpus, and every further time costs more (convex costs). A min-cost
flow routes pattern capacity to the source quotas; each pattern then takes whole documents once, twice, ... and part of them
once more, chosen by a seeded order, so that its words come near the routed flow.

Scale: sizes are counted in the scan (JVM regular expressions); from there on only ids and counts move. The seeded order is
never sorted as a whole: each pattern's documents are counted in 4096 bins of the seed's hash, twice over, and only the
documents of one bin of one bin (a 16-millionth of the pattern) are brought together to settle the last words.
Targets and flows are worked out by Spark too: sources that share no pattern, even over others, have nothing to do with each other, so each
connected group of sources is one flow in one task, which holds the group's patterns (not its documents). The driver only sees sums.

Defined cases: a null text has no words; a null source is a source of its own, after all others; rows that repeat a
document (same id, pattern and size) are taken or left together; a source without words has target 0; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.components import components
from tidewell.session import stored

WORD = r"[^\x20\x09-\x0D]+"
BINS = 4096
#: Sources by code point weigh so, again and again.
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def reshared_targets(sizes: list[int], weights: list[int], share: float, most: float) -> list[float]:
    """Targets by weight of share times all sizes, none above most times its size; what is above goes to the others by weight.

    The plain form over a list; targets() does the same over any number of sources.
    """
    total, out = share * sum(sizes), [0.0] * len(sizes)
    open_ = {i for i, s in enumerate(sizes) if s > 0}
    left = min(total, most * sum(sizes))
    while open_:
        w = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / w > most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def route(capacity: dict[tuple, int], quota: dict, most: int) -> dict[tuple, float]:
    """Min-cost flow: for each pattern (a tuple of sources) the words taken of it, over all times.

    Time k over a pattern costs k*k for each word, so no pattern is repeated while another of the same source is fresh. Sources
    that share no pattern are solved apart. Successive shortest augmenting paths on pattern and source nodes; each path fills an
    arc, of which there are (times x patterns + memberships).
    """
    taken: dict[tuple, float] = defaultdict(float)
    by_source: dict = defaultdict(list)
    for p in capacity:
        for s in p:
            by_source[s].append(p)
    seen: set = set()
    for first in by_source:
        if first in seen:
            continue
        group, todo = [], [first]
        seen.add(first)
        while todo:
            s = todo.pop()
            group.append(s)
            for p in by_source[s]:
                for o in p:
                    if o not in seen:
                        seen.add(o)
                        todo.append(o)
        patterns = sorted({p for s in group for p in by_source[s]}, key=repr)
        flow: dict = defaultdict(float)  # pattern, source
        need = {s: float(quota.get(s, 0.0)) for s in group}
        while True:
            # from every pattern with room, by the cost of its next word, to the cheapest source in need
            dist, back, heap, n = {}, {}, [], 0

            def reach(node: tuple, d: float, origin: tuple | None) -> None:
                nonlocal n
                if d < dist.get(node, 1e18):
                    dist[node], back[node], n = d, origin, n + 1
                    heapq.heappush(heap, (d, n, node))

            for p in patterns:
                time = int(taken[p] // capacity[p]) + 1 if capacity[p] else most + 1
                if time <= most:
                    reach(("pattern", p), float(time * time), None)
            end = None
            while heap:
                d, _, (kind, x) = heapq.heappop(heap)
                if d > dist[kind, x]:
                    continue
                if kind == "source":
                    if need[x] > 1e-9:
                        end = x
                        break
                    for p in by_source[x]:  # what another pattern gave goes elsewhere, and its place is free
                        if flow[p, x] > 1e-9:
                            reach(("pattern", p), d, ("source", x))
                else:
                    for s in x:
                        reach(("source", s), d, ("pattern", x))
            if end is None:
                break
            path, s, amount = [], end, need[end]
            while True:
                p = back["source", s][1]
                path.append((p, s))
                origin = back["pattern", p]
                if origin is None:
                    break
                s = origin[1]
                amount = min(amount, flow[p, s])
            amount = min(amount, (taken[p] // capacity[p] + 1) * capacity[p] - taken[p])
            s = end
            for i, (q, t) in enumerate(path):
                flow[q, t] += amount
                if i + 1 < len(path):
                    flow[q, path[i + 1][1]] -= amount
            taken[p] += amount
            need[end] -= amount
    return taken


def _pick(units: DataFrame, wanted: DataFrame) -> DataFrame:
    """units: pattern, unit, size, h; wanted: pattern, words. The units whose sizes come near words, by the order of h: pattern, unit."""

    def below(level: DataFrame, bin_: str, goal: DataFrame) -> DataFrame:
        """For each pattern the bin in which its words end, and the words still wanted there."""
        sums = level.groupBy("pattern", bin_).agg(F.sum("size").alias("words"))

        def cut(pdf):
            pdf = pdf.sort_values(bin_)
            goal_, before = float(pdf["goal"].iloc[0]), pdf["words"].cumsum() - pdf["words"]
            k = max(int((before <= goal_).sum()) - 1, 0)
            return pd.DataFrame({"pattern": [pdf["pattern"].iloc[0]], "at": [int(pdf[bin_].iloc[k])], "goal": [goal_ - float(before.iloc[k])]})

        return sums.join(goal, "pattern").groupBy("pattern").applyInPandas(cut, "pattern string, at int, goal double")

    by_bin = units.withColumn("b1", F.shiftrightunsigned("h", 52).cast("int")).withColumn("b2", (F.shiftrightunsigned("h", 40) % BINS).cast("int"))
    one = below(by_bin, "b1", wanted.select("pattern", F.col("words").alias("goal"))).withColumnRenamed("at", "at1").withColumnRenamed("goal", "goal1")
    one = stored(one)
    inner = by_bin.join(one, "pattern").where(F.col("b1") == F.col("at1"))
    two = stored(below(inner, "b2", one.select("pattern", F.col("goal1").alias("goal"))).withColumnRenamed("at", "at2").withColumnRenamed("goal", "goal2"))

    def settle(pdf):
        """First fit in the seeded order."""
        pdf = pdf.sort_values(["h", "unit"])
        left, keep = float(pdf["goal2"].iloc[0]), []
        for s in pdf["size"]:
            keep.append(s <= left)
            left -= s if keep[-1] else 0
        return pdf.loc[keep, ["pattern", "unit", "size"]]

    marked = by_bin.join(one, "pattern").join(two.select("pattern", "at2", "goal2"), "pattern", "left")
    whole = marked.where((F.col("b1") < F.col("at1")) | ((F.col("b1") == F.col("at1")) & (F.col("b2") < F.col("at2"))))
    last = marked.where((F.col("b1") == F.col("at1")) & (F.col("b2") == F.col("at2"))).select("pattern", "unit", "size", "h", "goal2")
    picked = stored(whole.select("pattern", "unit", "size").union(last.groupBy("pattern").applyInPandas(settle, "pattern string, unit string, size long")))
    # of all documents left out, the one whose size comes nearest to the words still missing
    got = picked.groupBy("pattern").agg(F.sum("size").alias("got"))
    missing = stored(wanted.join(got, "pattern", "left").select("pattern", (F.col("words") - F.coalesce("got", F.lit(0))).alias("missing")))
    off = F.abs(F.col("size") - F.col("missing"))
    one_more = (
        units.join(missing, "pattern")
        .where(off < F.col("missing"))
        .join(picked.select("pattern", "unit"), ["pattern", "unit"], "left_anti")
        .groupBy("pattern")
        .agg(F.min(F.struct(off.alias("off"), "h", "unit")).alias("best"))
        .select("pattern", "best.unit")
    )
    return picked.select("pattern", "unit").union(one_more)


def flows(capacity: DataFrame, quotas: DataFrame, most: int) -> DataFrame:
    """capacity: pattern, sources, words; quotas: source, quota. pattern, rounds (whole times that the flow takes it), words (taken beyond them).

    Each connected group of sources is solved by route() in a task of its own.
    """
    member = capacity.select("pattern", "words", F.posexplode("sources").alias("i", "source"), F.col("sources")[0].alias("first"))
    key = lambda c: F.xxhash64(c)
    groups = components(member.where("i > 0").select(key("source").alias("x"), key("first").alias("y")))
    placed = member.withColumn("node", key("first")).join(groups, "node", "left").withColumn("group", F.coalesce("label", "node"))
    wanted = placed.join(quotas, "source", "left").select("group", "pattern", "words", "source", F.coalesce("quota", F.lit(0.0)).alias("quota"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pattern", "source"])
        lists = pdf.groupby("pattern", sort=True).agg(sources=("source", tuple), words=("words", "first"))
        capacity_ = {sources: int(words) for sources, words in zip(lists["sources"], lists["words"], strict=True) if words > 0}
        taken = route(capacity_, dict(zip(pdf["source"], pdf["quota"], strict=True)), most)
        flow = [float(taken.get(sources, 0.0)) for sources in lists["sources"]]
        rounds = [min(most, int(f // w)) if w > 0 else 0 for f, w in zip(flow, lists["words"], strict=True)]
        return pd.DataFrame({"pattern": lists.index, "rounds": rounds, "words": [f - r * w for f, r, w in zip(flow, rounds, lists["words"], strict=True)]})

    return wanted.groupBy("group").applyInPandas(solve, "pattern string, rounds int, words double")


def mix(sizes: DataFrame, quotas: DataFrame, most: int, seed: int = 17) -> DataFrame:
    """sizes: doc_id, size, sources (sorted array). Adds pattern and taken, the words of each row that the mix takes.

    quotas: source, quota (words wanted of it). Whole documents are taken 0 to most times.
    """
    named = sizes.withColumn("pattern", F.to_json("sources"))
    named = named.withColumn("unit", F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string")))
    capacity = stored(named.groupBy("pattern", "sources").agg(F.sum("size").alias("words")))
    plan = stored(flows(capacity, quotas, most))
    units = (
        named.where("size > 0")
        .groupBy("pattern", "unit")
        .agg(F.sum("size").alias("size"))
        .withColumn("h", F.xxhash64("pattern", "unit", F.lit(seed)))
    )
    picked = _pick(units, plan.where("words > 0").select("pattern", "words")).withColumn("more", F.lit(1))
    return (
        named.join(plan.select("pattern", "rounds"), "pattern", "left")
        .join(picked, ["pattern", "unit"], "left")
        .withColumn("taken", (F.col("size") * (F.coalesce("rounds", F.lit(0)) + F.coalesce("more", F.lit(0)))).cast("long"))
        .drop("unit", "rounds", "more")
    )


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, parts: int = 32) -> DataFrame:
    """totals: source, size (a row a source). source, size, target; sources by code point, null last, weigh weights in turn.

    Sources are dealt to ranges and numbered within each; the driver adds up the ranges' counts. Then a source whose share by weight is more than most times
    its size stops there, and the others share what is left, until none stops: each round is one sum over the sources.
    """
    late = F.col("source").isNull()
    dealt = stored(totals.repartitionByRange(parts, late, "source").withColumn("part", F.spark_partition_id()))
    before, so_far = {}, 0
    for r in sorted(dealt.groupBy("part").agg(F.count("*").alias("n")).collect(), key=lambda r: r["part"]):
        before[r["part"]], so_far = so_far, so_far + r["n"]
    start = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("part")) if before else F.lit(0)
    place = start + F.row_number().over(W.partitionBy("part").orderBy(late, "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    rows = stored(dealt.select("source", "size", weight.alias("weight")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    everything, level = min(share * total, float(most * total)), 0.0
    while True:
        full = most * F.col("size") < level * F.col("weight")
        stopped, open_weight = rows.where("size > 0").agg(F.sum(F.when(full, most * F.col("size"))), F.sum(F.when(~full, F.col("weight")))).first()
        risen = (everything - (stopped or 0)) / open_weight if open_weight else level
        if risen <= level:
            break
        level = risen
    return rows.select("source", "size", F.when(F.col("size") > 0, F.least(level * F.col("weight"), (most * F.col("size")).cast("double"))).otherwise(0.0).alias("target"))


def mixed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, source, size, source_size, target, taken."""
    sizes = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    goals = targets(stored(sizes.groupBy("source").agg(F.sum("size").alias("size"))))
    # a null can't be in a pattern: sources go by an invented name for it, with a mark in front of all others
    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    goals = stored(goals.select(name.alias("t_source"), F.col("size").alias("source_size"), "target"))
    out = mix(sizes.withColumn("sources", F.array(name)), goals.select(F.col("t_source").alias("source"), F.col("target").alias("quota")), MOST)
    return out.join(goals, out["sources"][0] == goals["t_source"]).select("doc_id", "source", "size", "source_size", "target", "taken")


def taken_times(docs: DataFrame) -> DataFrame:
    """docs (with doc_id, text, source) and times: how often the mix takes each row, 0 to MOST; documents not taken are left out."""
    taken = mixed(docs.select("doc_id", "text", "source")).where("taken > 0")
    decided = taken.groupBy(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "source", "size")]).agg((F.max("taken") / F.max("size")).cast("int").alias("_times"))
    sized = docs.withColumn("_words", n_words(F.col("text")))
    match = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_words") == F.col("_size"))
    joined = sized.join(decided, match)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns if c != "times"], F.col("_times").alias("times"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op2_mixing": op2_mixing}
SQL: dict[str, str] = {}
