"""Null distributions of a mask's effect: rotations, restricted rotations, contiguous blocks, shuffled episodes, and the gates' thresholds.

The effect is the difference of the medians of masked and other returns. A series has one row a day, so what a null needs of it
(its returns in order, the places of its masked and of its other days) is one row of arrays; the shifts are dealt over the cluster in chunks of CHUNK
and each is worked out within a row. No day is copied for a shift. Where sums are enough (gates), only masked days meet the shifts, in an equi-join on places.

Defined cases: rows without a return must be left out before; a series without masked or without other days has null effects; series
too short for a shift give no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import series as S
from tidewell.operators import rolling, stats

CHUNK = 50
EXCLUSION = 30
#: Largest difference of the share of masked days in a tercile, and the least number of shifts that must be left.
TOLERANCE, LEAST_SHIFTS = 0.10, 200


def numpy_offsets(length: int, n: int, low: int, high: int, seed: int) -> list[int]:
    """n circular shifts in [low, high), drawn as NumPy's default generator draws them."""
    import numpy as np

    return [int(x) for x in np.random.default_rng(seed).integers(low, high, size=n)]


def unit_draws(n: int, seed: int) -> list[float]:
    """n draws from [0, 1), which shifts() scales to each series' own range."""
    import numpy as np

    return [round(float(x), 9) for x in np.random.default_rng(seed).random(n)]


def shifts(draws: list[float], low: Column, high: Column) -> Column:
    """An array of whole shifts from low to high, both included."""
    units = F.from_json(F.lit(json.dumps(draws)), "array<double>")
    return F.transform(units, lambda u: (low + F.floor(u * (high - low + 1))).cast("int"))


def inner_shifts(draws: list[float], exclusion: int = EXCLUSION) -> Column:
    """Shifts that stay exclusion rows away from the mask's own place."""
    return shifts(draws, F.lit(exclusion), F.col("l") - exclusion)


def middle(values: Column) -> Column:
    """The median of an array; null of an empty one."""
    return F.transform(F.array(F.sort_array(values)), lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2)[0]


def gathered(df: DataFrame, *more: str) -> DataFrame:
    """df (series, d, m, r and more) -> series, l, on, off (places of masked and other days), r and more as arrays in order of d."""
    i = (F.row_number().over(S.ordered()) - 1).cast("int")
    rows = df.select("series", "m", F.struct(i.alias("i"), "r", *more).alias("x"))
    places = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("x.i"))))
    got = rows.groupBy("series").agg(F.count("*").cast("int").alias("l"), places(F.col("m")).alias("on"), places(~F.col("m")).alias("off"), F.array_sort(F.collect_list("x")).alias("x"))
    return got.select("series", "l", "on", "off", *[F.col(f"x.{c}").alias(c) for c in ("r", *more)])


def _at(values: str, places: Column, shift: Column) -> Column:
    return F.transform(places, lambda p: F.get(F.col(values), ((p + shift) % F.col("l")).cast("int")))


def effect(shift: Column) -> Column:
    """The effect of a gathered row's mask turned by shift places."""
    return middle(_at("r", F.col("on"), shift)) - middle(_at("r", F.col("off"), shift))


def dealt(rows: DataFrame, items: Column, name: str) -> DataFrame:
    """rows once for each element of an array column, as name; chunks of them go to different tasks."""
    n = F.ceil(F.size("_items") / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.slice("_items", c * CHUNK + 1, CHUNK))
    cut = rows.withColumn("_items", items).where(F.size("_items") > 0).select(*rows.columns, F.posexplode(chunks).alias("_c", "_chunk"))
    return cut.repartition("series", "_c").select(*rows.columns, F.explode("_chunk").alias(name))


def _shares(t: Column, real: Column) -> list[Column]:
    share = lambda c: F.avg(c.cast("double"))
    return [F.count(t).alias("n"), share(t >= real).alias("p_positive"), share(t <= real).alias("p_negative"), share(F.abs(t) >= F.abs(real)).alias("p_both")]


def rotation_p_values(df: DataFrame, draws: list[float], exclusion: int = EXCLUSION) -> DataFrame:
    """series, theta and the shares of rotations whose theta is at least, at most, and in size at least as large."""
    rows = gathered(df).where(F.col("l") > 2 * exclusion).withColumn("theta", effect(F.lit(0)))
    null = dealt(rows, inner_shifts(draws, exclusion), "s").select("series", "theta", effect(F.col("s")).alias("t"))
    return null.groupBy("series", "theta").agg(*_shares(F.col("t"), F.col("theta")))


def past_terciles(bars: DataFrame, k: int = 30, days: int = 365) -> DataFrame:
    """series, d, t: 0, 1 or 2 by the volatility of k log returns against the terciles of the days rows before; null without them all."""
    x = bars.select("series", "d", F.log(S.close() / S.before(S.close())).alias("x")).withColumn("v", S.guarded(F.stddev_samp, F.col("x"), k))
    x = rolling.quantiles_of_rows(x, "v", {"q1": 1 / 3, "q2": 2 / 3}, days, 1)
    t = F.when(F.col("v") > F.col("q2"), 2).when(F.col("v") > F.col("q1"), 1).otherwise(0)
    return x.select("series", "d", F.when(F.col("q1").isNotNull() & F.col("v").isNotNull(), t).alias("t"))


def restricted_p_values(df: DataFrame, tolerance: float = TOLERANCE, least: int = LEAST_SHIFTS, exclusion: int = EXCLUSION) -> DataFrame:
    """series, n_admissible, evaluable, theta, p_positive, p_negative: every rotation that deals the masked days over terciles (column t) like the real mask does.

    All admissible shifts count, so nothing is drawn. Under least of them a series isn't evaluable.
    """
    share = lambda at, k: F.size(F.filter(at, lambda x: x == k)) / F.size("on")
    rows = gathered(df, "t").where((F.col("l") > 2 * exclusion) & (F.size("on") > 0))
    rows = rows.withColumn("base", F.transform(F.array(_at("t", F.col("on"), F.lit(0))), lambda a: F.array(*[share(a, k) for k in (0, 1, 2)]))[0])
    turned = dealt(rows, F.sequence(F.lit(exclusion), F.col("l") - exclusion), "s").withColumn("turned", _at("t", F.col("on"), F.col("s")))
    off = F.greatest(*[F.abs(share(F.col("turned"), k) - F.col("base")[k]) for k in (0, 1, 2)])
    found = turned.withColumn("good", off <= tolerance).select("series", "good", F.when(F.col("good"), effect(F.col("s"))).alias("t"))
    real = rows.select("series", effect(F.lit(0)).alias("theta"))
    got = found.join(real, "series").groupBy("series", "theta").agg(F.count_if("good").alias("n_admissible"), *_shares(F.col("t"), F.col("theta"))[1:3])
    enough = F.col("n_admissible") >= least
    return got.select("series", "n_admissible", enough.alias("evaluable"), "theta", *[F.when(enough, F.col(c)).alias(c) for c in ("p_positive", "p_negative")])


def contiguous_p_values(df: DataFrame) -> DataFrame:
    """series, theta, n, p: the share of contiguous blocks, as long as there are masked days, whose effect is at least the mask's. Every start counts."""
    rows = gathered(df).where((F.size("on") > 0) & (F.size("off") > 0)).withColumn("theta", effect(F.lit(0)))
    n = F.size("on")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(1), F.col("l") - n) - 1)
    block = middle(F.slice("r", F.col("s") + 1, n)) - middle(F.concat(F.slice("r", F.lit(1), F.col("s")), F.slice("r", F.col("s") + n + 1, F.col("l"))))
    null = dealt(rows, starts, "s").select("series", "theta", block.alias("t"))
    return null.groupBy("series", "theta").agg(F.count("t").alias("n"), F.avg((F.col("t") >= F.col("theta")).cast("double")).alias("p"))


def episode_p_values(df: DataFrame, draws: int) -> DataFrame:
    """series, theta, n, p_positive, p_negative: lengths of masked runs and of the runs between change places, each kind for itself.

    A draw k puts the runs in the order of md5("k:number of the run").
    """
    x = gathered(df).where((F.size("on") > 0) & (F.size("off") > 0)).withColumn("theta", effect(F.lit(0)))
    runs = stats.runs(df).withColumn("j", (F.row_number().over(W.partitionBy("series").orderBy("a")) - 1).cast("int"))
    listed = runs.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("j", "m", F.col("n").cast("int").alias("n")))).alias("runs"))
    rows = x.join(listed, "series")

    def shuffled(m: bool) -> Column:
        own = F.filter("runs", lambda x: x["m"] == F.lit(m))
        keyed = F.transform(own, lambda x: F.struct(F.md5(F.concat_ws(":", F.col("k").cast("string"), x["j"].cast("string"))).alias("h"), x["n"].alias("n")))
        return F.transform(F.array_sort(keyed), lambda x: x["n"])

    def let(value: Column, f) -> Column:
        """f of a value that is worked out once a row, not once for each element that looks at it."""
        return F.transform(F.array(value), f)[0]

    # runs take turns, so run j is the (j div 2)th of its kind
    nth = lambda of, x: F.get(of, F.floor(x["j"] / 2).cast("int"))
    lengths = lambda p: F.transform("runs", lambda x: F.struct(x["m"].alias("m"), F.when(x["m"], nth(p["yes"], x)).otherwise(nth(p["no"], x)).alias("n")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,z:int>>").alias("out"))
    span = lambda acc, x: F.struct(acc["at"].alias("a"), (acc["at"] + x["n"] - 1).alias("z"))
    step = lambda acc, x: F.struct((acc["at"] + x["n"]).alias("at"), F.when(x["m"], F.array_append(acc["out"], span(acc, x))).otherwise(acc["out"]).alias("out"))
    spans = let(F.struct(shuffled(True).alias("yes"), shuffled(False).alias("no")), lambda p: let(lengths(p), lambda q: F.aggregate(q, start, step, lambda acc: acc["out"])))
    drawn = dealt(rows, F.sequence(F.lit(0), F.lit(draws - 1)), "k").withColumn("spans", spans)
    placed = drawn.withColumn("on", F.flatten(F.transform("spans", lambda x: F.sequence(x["a"], x["z"]))))
    placed = placed.withColumn("off", F.array_except(F.sequence(F.lit(0), F.col("l") - 1), "on"))
    null = placed.select("series", "theta", effect(F.lit(0)).alias("t"))
    return null.groupBy("series", "theta").agg(*_shares(F.col("t"), F.col("theta"))[:3])


def spliced(df: DataFrame, days: int = 30) -> DataFrame:
    """series, spliced: whether a rotation joins masked days at the end with masked days at the start to one episode."""
    i = F.row_number().over(S.ordered()) - 1
    x = df.select("series", "m", i.alias("i"), F.count("*").over(S.whole()).alias("l"))
    last, first = F.max(F.when(F.col("m") & (F.col("i") >= F.col("l") - days), F.col("i"))), F.min(F.when(F.col("m") & (F.col("i") < days), F.col("i")))
    got = x.groupBy("series", "l").agg(last.alias("last"), first.alias("first"))
    return got.select("series", F.coalesce(F.col("l") - 1 - F.col("last") + F.col("first") + 1 <= days, F.lit(False)).alias("spliced"))


def masked_places(df: DataFrame, draws: list[float], *values: str) -> DataFrame:
    """series, k, l and values of the rows that the turned mask of each draw k covers; shifts from 1 to l - 1."""
    i = (F.row_number().over(S.ordered()) - 1).cast("int")
    placed = df.select("series", "m", *values, i.alias("i"), F.count("*").over(S.whole()).cast("int").alias("l")).where("l > 1")
    turned = placed.where("m").select("series", "l", "i", F.posexplode(shifts(draws, F.lit(1), F.col("l") - 1)).alias("k", "s"))
    turned = turned.select("series", "k", "l", ((F.col("i") + F.col("s")) % F.col("l")).cast("int").alias("i"))
    return turned.join(placed.select("series", "i", *values), ["series", "i"]).drop("i")


def threshold(null: DataFrame, t: str, draws: int, share: float = 0.95) -> DataFrame:
    """null: series and a statistic of each draw. series, n (finite ones), threshold; none where fewer than half the draws are finite."""
    x = null.where(F.col(t).isNotNull() & ~F.isnan(t))
    return x.groupBy("series").agg(F.count("*").alias("n"), F.percentile(t, F.lit(share)).alias("threshold")).where(F.col("n") >= draws // 2)


def segment_rho_null(df: DataFrame, draws: list[float], n_segments: int) -> DataFrame:
    """df (series, d, segment, m, r) -> series, k, t: the size of the median over segments of the rank correlation of the turned mask and r.

    A mask has two values, so its rank correlation is Pearson's of the mask and the ranks of r: sums over masked rows are enough.
    """
    ranked = df.withColumn("rank", stats.average_rank("r", ["series", "segment"]))
    whole = ranked.groupBy("series", "segment").agg(F.count("*").alias("n"), F.avg("rank").alias("mean"), F.stddev_pop("rank").alias("sd"))
    sums = masked_places(ranked, draws, "segment", "rank").groupBy("series", "k", "segment").agg(F.count("*").alias("c"), F.sum("rank").alias("sum"))
    p = F.col("c") / F.col("n")
    spread = F.sqrt(p * (1 - p)) * F.col("sd")
    rho = F.when((F.col("n") >= 3) & (spread > 0), (F.col("sum") - F.col("c") * F.col("mean")) / F.col("n") / F.when(spread > 0, spread))
    each = sums.join(whole, ["series", "segment"]).select("series", "k", rho.alias("rho"))
    return each.groupBy("series", "k").agg(F.when(F.count("rho") == n_segments, F.abs(F.percentile("rho", F.lit(0.5)))).alias("t"))


def gain_null(df: DataFrame, draws: list[float], base: list[str], y: str) -> DataFrame:
    """df (series, d, m, base, y) -> series, k, t: what the turned mask adds to R2 (percentage points), from sums over its rows."""
    x = df.dropna(subset=[*base, "m", y])
    names = [*base, y]
    fixed = x.groupBy("series").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in names], *[F.covar_pop(a, b).alias(f"{a}:{b}") for i, a in enumerate(names) for b in names[: i + 1]])
    sums = masked_places(x, draws, *names).groupBy("series", "k").agg(F.count("*").alias("c"), *[F.sum(c).alias(f"sum_{c}") for c in names])
    order = [*base, "m", y]
    cov = lambda a, b: F.col(f"`{a}:{b}`" if names.index(a) >= names.index(b) else f"`{b}:{a}`")
    with_m = lambda c: (F.col(f"sum_{c}") - F.col("c") * F.col(f"mean_{c}")) / F.col("n")
    share = F.col("c") / F.col("n")

    def s(i: int, j: int) -> Column:
        a, b = order[i], order[j]
        return share * (1 - share) if a == b == "m" else with_m(a if b == "m" else b) if "m" in (a, b) else cov(a, b)

    joined = sums.join(fixed, "series").select("series", "k", "n", *[s(i, j).alias(f"s{i}_{j}") for i in range(len(order)) for j in range(i + 1)])
    return stats.cholesky_gain(joined, len(base), ["series", "k"]).select("series", "k", F.col("gain").alias("t"))
