"""What the panel says in words: ladders, trends, notices and their priority, the one-sentence summary, the state of calendars and digests.

Defined cases: a null value gets the ladder's word for missing data, or null where it has none; a series without history gives no notice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import series as S
from tidewell.operators import calendar

# Labels by percentile of the ratio of market to realised value, by the ratio itself, and by its z-score; the last is the rest.
RATIO_PERCENTILES, RATIO_REST = [(94, "EUFORIA"), (80, "OPTIMISMO ALTO"), (35, "ZONA MEDIA"), (15, "ZONA BAJA")], "CAPITULACIÓN"
RATIOS = [(3.5, "EUFORIA"), (2.5, "OPTIMISMO ALTO"), (1.5, "ZONA MEDIA-ALTA"), (1.0, "ZONA MEDIA-BAJA")]
Z_SCORES, Z_REST = [(5, "EXTREMO ALTO"), (3, "ALTO"), (1, "NORMAL-ALTO"), (0, "NORMAL-BAJO")], "EXTREMO BAJO"
MISSING = "SIN DATOS"
# How a valuation percentile and a volatility tercile are put into words.
VALUE_WORDS = [
    (80, "está caro según su propia historia"), (60, "está algo por encima de su media histórica"),
    (40, "está en su rango normal de valoración"), (20, "está algo por debajo de su media histórica"),
]
VALUE_REST = "está barato según su propia historia"
VOL_WORDS = {
    "Bajo": "se mueve poco frente a los últimos 6 años",
    "Normal": "se mueve dentro de lo habitual de los últimos 6 años",
    "Elevado": "se mueve más de lo habitual de los últimos 6 años",
}
VOL_UNKNOWN = "tiene una volatilidad difícil de clasificar ahora mismo"
# The notices of the summary, the most urgent first.
URGENT = [
    "la calibración del panel puede no ser fiable ahora mismo (ver el aviso en el bloque 06)",
    "estás en una ventana histórica ligada al ciclo de halving",
    "hay un evento macro importante en los próximos días",
]
DIVERSIFIES_LITTLE = ", y apenas diversifica frente a la bolsa tradicional"
# The light for coming events.
LIGHTS = ["● Evento inminente", "◐ Evento esta semana", "○ Sin eventos"]
# Names of months and weekdays (from Monday).
MONTHS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]
DAYS = ["lunes", "martes", "miércoles", "jueves", "viernes", "sábado", "domingo"]
#: Points between the 95th percentiles of all times and of late that are worth a notice.
TAIL_GAP = 15
OLD_DAYS, LEAST_MONTHS = 10, 3


def ratio_label(percentile: Column) -> Column:
    return S.ladder(percentile, RATIO_PERCENTILES, RATIO_REST, missing=MISSING)


def fixed_ratio_label(ratio: Column) -> Column:
    return S.ladder(ratio, RATIOS, RATIO_REST, missing=MISSING)


def z_label(z: Column) -> Column:
    return S.ladder(z, Z_SCORES, Z_REST, missing=MISSING)


def trend(change: Column, limit: float) -> Column:
    """Of a change in percent; null for none."""
    return F.when(change > limit, "creciendo").when(change > -limit, "estable").when(change.isNotNull(), "cayendo")


def value_words(percentile: Column) -> Column:
    return S.ladder(percentile, VALUE_WORDS, VALUE_REST)


def vol_words(label: Column) -> Column:
    out = F.lit(VOL_UNKNOWN)
    for name, words in VOL_WORDS.items():
        out = F.when(label == name, F.lit(words)).otherwise(out)
    return out


def notices(regime: DataFrame, calibration: DataFrame, tails: DataFrame) -> DataFrame:
    """series, source, level of what the three checks of a panel have to say."""
    one = regime.where("active").select("series", F.lit("regime").alias("source"), F.lit("alto").alias("level"))
    two = calibration.where("degenerate OR unbalanced").select("series", F.lit("calibration").alias("source"), F.when(F.col("degenerate"), "alto").otherwise("medio").alias("level"))
    gap = F.col("p95_total") - F.col("p95_recent")
    three = tails.where(F.abs(gap) > TAIL_GAP).select("series", F.lit("tails").alias("source"), F.when(gap > 0, "medio").otherwise("alto").alias("level"))
    return one.unionByName(two).unionByName(three)


def sentence(value: Column, vol_label: Column, correlation_tranche: Column, alarm: Column, halving: Column, event: Column) -> Column:
    """The summary: value and volatility in words, then the most urgent of the notices (booleans) that hold."""
    none = F.lit("")
    urgent = F.coalesce(*[F.when(flag, F.lit(words)) for flag, words in zip((alarm, halving, event), URGENT, strict=True)])
    middle = F.when(correlation_tranche == "alta", F.lit(DIVERSIFIES_LITTLE)).otherwise(none)
    tail = F.when(urgent.isNotNull(), F.concat(F.lit(" — y "), urgent)).otherwise(none)
    return F.concat(F.lit("Ahora mismo, BTC "), value_words(F.coalesce(value, F.lit(50.0))), F.lit(" y "), vol_words(F.coalesce(vol_label, none)), middle, tail, F.lit("."))


def noise(days: DataFrame, events: DataFrame, soon: int = 2, within: int = 7) -> DataFrame:
    """days (d) with the days until the next event of high weight within within days, and the light that says so."""
    high = events.where("weight = 'alta'").select(F.col("d").alias("e"))
    near = days.join(high, F.date_diff("e", "d").between(0, within), "left").groupBy("d").agg(F.min(F.date_diff("e", "d")).alias("days"))
    light = F.when(F.col("days") <= soon, LIGHTS[0]).when(F.col("days").isNotNull(), LIGHTS[1]).otherwise(LIGHTS[2])
    return near.select("d", "days", light.alias("light"))


def monthly_move(vol: Column) -> Column:
    """The usual move of 30 days at an annual volatility, in percent."""
    return vol * F.sqrt(F.lit(30 / 365)) * 100


def exit_reference(last: DataFrame, given: Column, near: float = 250.0) -> DataFrame:
    """last: series, close, sma200. The average as exit where the price is above it, and whether the given exit uses it."""
    reference = F.when(F.col("close") > F.col("sma200"), F.round("sma200", 3))
    return last.select("series", reference.alias("reference"), F.coalesce(F.abs(given - reference) <= near, F.lit(False)).alias("used"))


def sufficiency(days: DataFrame, events: DataFrame) -> DataFrame:
    """days (d): whether the calendar still reaches LEAST_MONTHS months of 30.4 days beyond, and to when."""
    last = events.agg(F.max("d").alias("last"))
    got = days.join(F.broadcast(last)).withColumn("until", F.when(F.col("last") >= F.col("d"), F.col("last")))
    months = F.date_diff("until", "d") / 30.4
    return got.select("d", "until", F.round(months, 6).alias("months"), F.coalesce(months >= LEAST_MONTHS, F.lit(False)).alias("ok"))


def age(made: Column, now: Column) -> tuple[Column, Column]:
    """Days since an ISO time in text (null where it is none), and whether that is too old."""
    at = F.try_to_timestamp(made)
    days = (F.unix_micros(now) - F.unix_micros(at)) / 86_400_000_000
    return days, F.coalesce(days > OLD_DAYS, F.lit(False))


def spoken_date(d: Column) -> Column:
    """A date as "lunes 5 de enero de 2026"."""
    name = lambda words, k: F.element_at(F.array(*map(F.lit, words)), k)
    return F.concat(name(DAYS, F.weekday(d) + 1), F.lit(" "), F.dayofmonth(d).cast("string"), F.lit(" de "), name(MONTHS, F.month(d)), F.lit(" de "), F.year(d).cast("string"))


def aligned(frames: dict[str, DataFrame]) -> DataFrame:
    """frames by name, each series, d, value -> series, d and a column for each name: every day that any of them has. One aggregate, no chain of outer joins."""
    rows = None
    for name, df in frames.items():
        one = df.select("series", "d", F.lit(name).alias("_name"), F.col("value").cast("double").alias("_value"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("series", "d").agg(*[F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in frames])


def coverage(df: DataFrame, columns: list[str], epoch: Column) -> DataFrame:
    """epoch, column, days, present, share of the days on which a column has a value."""
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNotNull().alias("has")) for c in columns]))
    got = df.select(epoch.alias("epoch"), long.alias("x")).groupBy("epoch", "x.column").agg(F.count("*").alias("days"), F.count_if("x.has").alias("present"))
    return got.select("epoch", "column", "days", "present", *S.rounded(share=F.col("present") / F.col("days")))


def common_days(price: DataFrame, denominator: DataFrame) -> DataFrame:
    """series, common, without_price, first_without_price: days of a denominator that have a price, and those that have none."""
    mine = denominator.select("series", "d").join(price.select("series", "d", F.lit(True).alias("priced")), ["series", "d"], "left")
    bare = F.col("priced").isNull()
    return mine.groupBy("series").agg(F.count("priced").alias("common"), F.count_if(bare).alias("without_price"), F.min(F.when(bare, F.col("d"))).alias("first_without_price"))


def overlap_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new: series, d, value. For each series of old whether new repeats it: days missing from new, values that differ, the first of either.

    Values are compared without tolerance; two nulls, and two NaN, are equal.
    """
    other = new.select("series", "d", F.col("value").alias("_now"), F.lit(True).alias("_there"))
    j = old.select("series", "d", "value").join(other, ["series", "d"], "left")
    gone = F.col("_there").isNull()
    off = ~gone & ~F.col("value").eqNullSafe(F.col("_now"))
    first = lambda c: F.min(F.when(c, F.col("d")))
    got = j.groupBy("series").agg(F.count("_there").alias("common"), F.count_if(gone).alias("missing"), first(gone).alias("first_missing"), F.count_if(off).alias("different"), first(off).alias("first_different"))
    return got.withColumn("identical", (F.col("missing") == 0) & (F.col("different") == 0))


def checked_extension(old: DataFrame, new: DataFrame) -> DataFrame:
    """new, unless it revises what old holds: then an error names the series and days."""
    bad = overlap_diff(old, new).where("NOT identical").limit(5).collect()
    if bad:
        raise ValueError("revised data: " + "; ".join(f"{r['series']}: {r['missing']} missing from {r['first_missing']}, {r['different']} different from {r['first_different']}" for r in bad))
    return new


def gap_policy(df: DataFrame, fill: int = 2) -> DataFrame:
    """series, gaps, longest, action: nothing, fill (gaps of at most fill days), abort (a longer one)."""
    gaps = calendar.runs(calendar.missing(calendar.days(df), df)).groupBy("series").agg(F.count("*").alias("gaps"), F.max("n").alias("longest"))
    got = df.select("series").distinct().join(gaps, "series", "left").select("series", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "longest")])
    return got.withColumn("action", F.when(F.col("longest") == 0, "nothing").when(F.col("longest") <= fill, "fill").otherwise("abort"))


def declared_gap_problems(declared: DataFrame, business: bool = True) -> DataFrame:
    """declared: series, k, a, z, few rows a series, in order of k. Adds problem: reversed, weekend, out of order (it starts before the last sound one ends), or null."""
    listed = declared.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("k", "a", "z"))).alias("rows"))
    weekend = lambda d: F.weekday(d) > 4

    def step(acc: Column, x: Column) -> Column:
        problem = F.when(x["z"] < x["a"], "reversed")
        problem = problem.when(weekend(x["a"]) | weekend(x["z"]), "weekend") if business else problem
        problem = problem.when(F.coalesce(x["a"] <= acc["last"], F.lit(False)), "out of order")
        one = F.struct(x["k"].alias("k"), x["a"].alias("a"), x["z"].alias("z"), problem.alias("problem"))
        return F.struct(F.when(problem.isNull(), x["z"]).otherwise(acc["last"]).alias("last"), F.array_append(acc["out"], one).alias("out"))

    kind = declared.schema["k"].dataType.simpleString()
    start = F.struct(F.lit(None).cast("date").alias("last"), F.array().cast(f"array<struct<k:{kind},a:date,z:date,problem:string>>").alias("out"))
    return listed.select("series", F.explode(F.aggregate("rows", start, step, lambda acc: acc["out"])).alias("x")).select("series", "x.*")


def first_of_each(df: DataFrame, by: str, order: str, k: int) -> DataFrame:
    """The first k rows of each by, in the order in which they came."""
    from pyspark.sql import Window as W

    return df.withColumn("_i", F.row_number().over(W.partitionBy(by).orderBy(order))).where(F.col("_i") <= k).drop("_i")
