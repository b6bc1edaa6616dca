"""Price levels of bars: weeks, periods, swing pivots, zones, volume profiles, as-of values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import series as S

#: A pivot joins a zone when it is so near to its last price, and the zone stays so narrow.
GAP, SPAN = 4000.0, 12000.0
BINS = 40


def weekly(bars: DataFrame) -> DataFrame:
    """Bars of weeks, dated by their Sunday."""
    week = F.date_add(F.date_trunc("week", "d").cast("date"), 6)
    return (
        bars.groupBy("series", week.alias("week"))
        .agg(F.min_by("open", "d").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "d").alias("close"), F.sum("vol").alias("vol"))
        .withColumnRenamed("week", "d")
    )


def drawdown_by_period(bars: DataFrame, periods: list[tuple[str, str, str]], least: int = 30) -> DataFrame:
    """The deepest fall of each series in each period that has at least so many days."""
    spark = bars.sparkSession
    dim = spark.createDataFrame(periods, "period string, a string, b string").select("period", F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    joined = bars.join(F.broadcast(dim), F.col("d").between(F.col("a"), F.col("b")))
    high = F.max("close").over(W.partitionBy("period", "series").orderBy("d").rowsBetween(W.unboundedPreceding, 0))
    falls = joined.select("period", "series", (F.col("close") / high - 1).alias("dd"))
    return falls.groupBy("period", "series").agg(F.count("*").alias("days"), F.round(F.min("dd"), 4).alias("deepest")).where(F.col("days") >= least)


def pivots(bars: DataFrame, side: int = 10) -> DataFrame:
    """series, d, kind, price: highs and lows that no bar of side rows before or after exceeds; a bar may be both."""
    w = S.rows(-side, side)
    whole = F.count("*").over(w) == 2 * side + 1
    high = F.when(whole & (F.col("high") == F.max("high").over(w)), F.struct(F.lit("high").alias("kind"), F.col("high").alias("price")))
    low = F.when(whole & (F.col("low") == F.min("low").over(w)), F.struct(F.lit("low").alias("kind"), F.col("low").alias("price")))
    found = bars.select("series", "d", F.array_compact(F.array(high, low)).alias("p"))
    return found.select("series", "d", F.explode("p").alias("p")).select("series", "d", "p.kind", "p.price")


def zones(points: DataFrame, gap: float = GAP, span: float = SPAN) -> DataFrame:
    """Zones of pivots by price: a pivot within gap of the last one and span of the zone's lowest belongs to it. Equal counts of kinds: high.

    Prices further apart than gap cut a series into stretches that don't touch each other. Within one the fold keeps where zones begin: no more
    than the stretch's width over span, so that what is copied doesn't grow with the pivots.
    """
    by_price = W.partitionBy("series").orderBy("price")
    prices = points.select("series", "price").distinct()
    cut = F.coalesce(F.col("price") - F.lag("price").over(by_price) > gap, F.lit(True))
    stretches = prices.withColumn("stretch", F.sum(cut.cast("int")).over(by_price)).groupBy("series", "stretch").agg(F.array_sort(F.collect_list("price")).alias("prices"))
    step = lambda acc, x: F.when(x - F.element_at(acc, -1) <= span, acc).otherwise(F.array_append(acc, x))
    begun = stretches.select("series", F.explode(F.aggregate("prices", F.array(F.col("prices")[0]), step)).alias("price"))
    numbered = begun.withColumn("zone", F.row_number().over(by_price))
    rows = points.join(numbered, ["series", "price"], "left")
    flat = rows.withColumn("zone", F.max("zone").over(by_price.rangeBetween(W.unboundedPreceding, 0)))
    return flat.groupBy("series", "zone").agg(
        F.round(F.avg("price"), 2).alias("center"),
        F.min("price").alias("low"),
        F.max("price").alias("high"),
        F.count("*").alias("touches"),
        F.when(F.count_if(F.col("kind") == "high") >= F.count_if(F.col("kind") == "low"), "high").otherwise("low").alias("kind"),
        F.max("d").alias("last_touch"),
    )


def nearest(found: DataFrame, bars: DataFrame, most: int = 4) -> DataFrame:
    """The zones nearest to the last close on both sides; one that holds the price is neither."""
    last = bars.groupBy("series").agg(F.max_by("close", "d").alias("now"))
    sided = found.join(last, "series").where((F.col("high") < F.col("now")) | (F.col("low") > F.col("now")))
    sided = sided.withColumn("side", F.when(F.col("high") < F.col("now"), "support").otherwise("resistance"))
    order = W.partitionBy("series", "side").orderBy(F.when(F.col("side") == "support", -F.col("center")).otherwise(F.col("center")))
    return sided.withColumn("nearest", F.row_number().over(order)).where(F.col("nearest") <= most).select("series", "side", "nearest", "center", "touches")


def volume_profile(bars: DataFrame, n: int = BINS, least: int = 30) -> DataFrame:
    """Share of volume in each of n equal price bins; a bar's volume is dealt evenly over the bins between its low and its high."""
    edges = bars.groupBy("series").agg(F.min("low").alias("lo"), ((F.max("high") - F.min("low")) / n).alias("w"), F.count("*").alias("rows")).where(F.col("rows") >= least)
    place = lambda x: F.least(F.floor((F.col(x) - F.col("lo")) / F.col("w")), F.lit(n - 1)).cast("int")
    dealt = bars.join(edges, "series").where("w > 0").select("series", "vol", "lo", "w", place("low").alias("a"), place("high").alias("z"))
    binned = dealt.select("series", "lo", "w", (F.col("vol") / (F.col("z") - F.col("a") + 1)).alias("v"), F.explode(F.sequence("a", "z")).alias("bin"))
    sums = binned.groupBy("series", "bin", "lo", "w").agg(F.sum("v").alias("v"))
    share = 100 * F.col("v") / F.sum("v").over(W.partitionBy("series"))
    return sums.select("series", "bin", F.round(F.col("lo") + F.col("bin") * F.col("w"), 2).alias("low"), F.round(F.col("lo") + (F.col("bin") + 1) * F.col("w"), 2).alias("high"), F.round(share, 6).alias("share"))


def period_levels(bars: DataFrame, months: tuple[int, ...] = (3, 6, 12, 24, 1200), least: int = 5) -> DataFrame:
    """Highest high and lowest low of the last so many months; null under least rows."""
    dated = bars.withColumn("last", F.max("d").over(S.whole()))
    within = dated.select("series", "d", "last", "high", "low", F.explode(F.array(*map(F.lit, months))).alias("months")).where(F.col("d") >= F.add_months("last", -F.col("months")))
    enough = lambda x: F.when(F.count("*") >= least, x)
    return within.groupBy("series", "months").agg(enough(F.max("high")).alias("high"), enough(F.min("low")).alias("low"))


def asof(left: DataFrame, right: DataFrame, strict: bool = False, most_days: int | None = None) -> DataFrame:
    """left (series, d) with m: the latest row of right (series, d, ...) dated at or before d (before it, if strict).

    Both sides are put on one time line and the last row of right is carried along it: one shuffle by series, no range join.
    """
    own = right.select("series", "d", F.struct(*[c for c in right.columns if c != "series"]).alias("m"), F.lit(1 if strict else 0).alias("turn"))
    asked = left.withColumns({"m": F.lit(None).cast(own.schema["m"].dataType), "turn": F.lit(0 if strict else 1)})
    line = asked.unionByName(own, allowMissingColumns=True)
    order = W.partitionBy("series").orderBy("d", "turn").rowsBetween(W.unboundedPreceding, 0)
    found = line.withColumn("m", F.last("m", ignorenulls=True).over(order)).where(F.col("turn") == (0 if strict else 1)).drop("turn")
    if most_days is None:
        return found
    return found.withColumn("m", F.when(F.date_diff("d", F.col("m.d")) <= most_days, F.col("m")))
