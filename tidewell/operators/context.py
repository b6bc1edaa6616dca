"""The context panel: what the last bar of each series says, in one row a series (or a few)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import series as S

# Valuation bands by percentile, in falling order, and the label below all.
VALUATION = [(85, "HISTÓRICAMENTE CARO"), (65, "POR ENCIMA DE LA MEDIA"), (35, "ZONA NORMAL"), (15, "POR DEBAJO DE LA MEDIA")]
VALUATION_REST = "HISTÓRICAMENTE BARATO"
# Quartile cuts of annual volatility, their labels, and each label's expected 30-day ranges (25, 50, 75, 95 % and months).
VOL_CUTS, VOL_LABELS = [0.42, 0.58, 0.81], ["muy baja", "baja", "alta", "muy alta"]
VOL_RANGES = [("muy baja", 0.12, 0.22, 0.34, 0.71, 1358), ("baja", 0.14, 0.22, 0.34, 0.85, 1357), ("alta", 0.18, 0.25, 0.37, 0.76, 1357), ("muy alta", 0.26, 0.39, 0.61, 1.40, 1357)]
# Falls in percent.
FALLS = [-30, -50, -70, -85]
# Labels of the terciles over six years.
TERCILES = ["Bajo", "Normal", "Elevado"]
REFERENCE_ROWS, EDGE, PERSISTENT = 1095, 0.10, 60


def latest(df: DataFrame) -> DataFrame:
    """Each series' last row."""
    return df.groupBy("series").agg(F.max_by(F.struct(*[c for c in df.columns if c != "series"]), "d").alias("r")).select("series", "r.*")


def percent(x: Column) -> Column:
    return (x - 1) * 100


def situation(bars: DataFrame) -> DataFrame:
    """Price against its averages, its last 365 rows, its volatility of five years and its all-time high."""
    w = S.trailing(365)
    x = bars.withColumn("ret", S.change(S.close())).withColumn("vol", S.volatility(F.col("ret"), 90) * 100)
    full = lambda c: F.when(F.count("*").over(w) == 365, c)
    x = x.select(
        "series", "d", "close", "vol",
        *[S.sma(S.close(), k).alias(f"sma{k}") for k in (50, 200, 1000)],
        full(F.min("close").over(w)).alias("min_365d"),
        full(F.max("close").over(w)).alias("max_365d"),
        F.max("d").over(S.whole()).alias("last"),
        F.max_by("vol", "d").over(S.whole()).alias("vol_now"),
    )
    recent = F.col("vol").isNotNull() & (F.col("d") >= F.date_sub("last", 1826))
    facts = x.groupBy("series").agg(
        F.max("close").alias("ath"),
        F.max_by("d", F.struct("close", -F.unix_date("d"))).alias("ath_date"),
        F.when(F.count_if(recent) >= 100, F.avg(F.when(recent, (F.col("vol") < F.col("vol_now")).cast("double"))) * 100).alias("vol_percentile"),
    )
    now = latest(x.drop("last", "vol_now")).join(facts, "series")
    place = (S.close() - F.col("min_365d")) / (F.col("max_365d") - F.col("min_365d")) * 100
    return now.select(
        "series", "d", F.col("close").alias("price"), *[F.round(f"sma{k}", 3).alias(f"sma{k}") for k in (50, 200, 1000)],
        *S.rounded(**{f"vs_sma{k}": percent(S.close() / F.col(f"sma{k}")) for k in (50, 200, 1000)}, position_365d=place, vol=F.col("vol"), vol_percentile=F.col("vol_percentile"), from_ath=percent(S.close() / F.col("ath"))),
        "min_365d", "max_365d", "ath", "ath_date",
    )


def valuation(bars: DataFrame) -> DataFrame:
    """Price over its average of 200 rows, that ratio's strict percentile in its own history, and the band's label."""
    m = bars.select("series", "d", (S.close() / S.sma(S.close(), 200)).alias("m")).where("m IS NOT NULL")
    m = m.withColumn("now", F.max_by("m", "d").over(S.whole()))
    p = m.groupBy("series").agg(F.max("d").alias("d"), F.first("now").alias("mayer"), S.strict_percentile(F.col("m"), F.col("now")).alias("p"))
    return p.select("series", "d", *S.rounded(mayer=F.col("mayer"), percentile=F.col("p")), S.ladder(F.col("p"), VALUATION, VALUATION_REST).alias("label"))


def cycle(bars: DataFrame) -> DataFrame:
    """Fall from the high, days since it, and returns over 30, 90 and 365 rows."""
    x = bars.select("series", "d", "close", S.drawdown(S.close()).alias("dd"), *[S.change(S.close(), k).alias(f"r{k}") for k in (30, 90, 365)])
    high = bars.groupBy("series").agg(F.max_by("d", F.struct("close", -F.unix_date("d"))).alias("ath_date"))
    now = latest(x).join(high, "series")
    return now.select("series", "d", *S.rounded(drawdown=F.col("dd") * 100, **{f"ret_{k}": F.col(f"r{k}") * 100 for k in (30, 90, 365)}), F.date_diff("d", "ath_date").alias("days_since_ath"))


def risk(bars: DataFrame, capital: float, falls: list[int] | None = None) -> DataFrame:
    """What falls of the last price leave of a capital, and the rise that makes up for them."""
    f = F.col("fall")
    now = latest(bars.select("series", "d", "close")).withColumn("fall", F.explode(F.array(*[F.lit(float(x)) for x in falls or FALLS])))
    left = capital * (1 + f / 100)
    return now.select("series", f.cast("int").alias("fall"), F.round(S.close() * (1 + f / 100), 3).alias("price"), *S.rounded(left=left, loss=capital - left, rise_needed=percent(capital / left)))


def log_vol(bars: DataFrame, k: int) -> DataFrame:
    """bars with v, the annual volatility of log returns over k rows."""
    return bars.withColumn("_r", F.log(S.close() / S.before(S.close()))).withColumn("v", S.volatility(F.col("_r"), k)).drop("_r")


def expected_range(bars: DataFrame) -> DataFrame:
    """The 30-day ranges that go with the quartile of the last volatility, as prices around the last one."""
    v = log_vol(bars, 30).select("series", "d", "close", "v")
    now = latest(v)
    p = v.where("v IS NOT NULL").join(now.select("series", F.col("v").alias("now")), "series").groupBy("series").agg(S.strict_percentile(F.col("v"), F.col("now")).alias("vol_percentile"))
    ranges = bars.sparkSession.createDataFrame(VOL_RANGES, "quartile string, p25 double, p50 double, p75 double, p95 double, months int")
    placed = now.withColumn("quartile", S.bins(F.col("v"), VOL_CUTS, VOL_LABELS)).join(F.broadcast(ranges), "quartile").join(p, "series")
    shares = ("p25", "p50", "p75", "p95")
    bands = [x for k in shares for x in (F.round(S.close() / (1 + F.col(k) / 2), 3).alias(f"low_{k}"), F.round(S.close() * (1 + F.col(k) / 2), 3).alias(f"high_{k}"))]
    return placed.select("series", "d", "quartile", "months", *shares, F.col("close").alias("price"), *S.rounded(vol=F.col("v"), vol_percentile=F.col("vol_percentile")), *bands)


def position_sizes(ranges: DataFrame, capital: float, loss: float) -> DataFrame:
    """The capital whose loss stays within loss in three scenarios, never more than there is."""
    cases = F.array(*[F.struct(F.lit(n).alias("scenario"), (F.col(c) / 2).alias("fall")) for n, c in (("típico", "p50"), ("prudente", "p75"), ("adverso", "p95"))])
    x = ranges.select("series", F.explode(cases).alias("c")).select("series", "c.scenario", "c.fall")
    most = loss / F.col("fall")
    return x.select("series", "scenario", *S.rounded(fall=F.col("fall") * 100, capital=F.least(most, F.lit(capital))), (most > capital).alias("above_capital"))


def regime_change(bars: DataFrame) -> DataFrame:
    """Whether volatility of 90 rows has been outside its historical band on each of the last PERSISTENT rows.

    A series under REFERENCE_ROWS rows is inactive for want of history: reason says so, its numbers are null.
    """
    v = log_vol(bars, 90).where("v IS NOT NULL").select("series", "d", "v")
    v = v.withColumn("back", F.row_number().over(S.whole().orderBy(F.desc("d"))))
    past = F.when(F.col("back") > 1, F.col("v"))
    band = v.groupBy("series").agg(F.percentile(past, F.lit(EDGE)).alias("lo"), F.percentile(past, F.lit(1 - EDGE)).alias("hi"), F.max_by("v", "d").alias("now"), F.count("*").alias("n")).where(F.col("n") >= REFERENCE_ROWS)
    joined = v.join(band, "series")
    out = joined.groupBy("series", "lo", "hi", "now").agg(
        F.count_if((F.col("back") <= PERSISTENT) & ((F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi")))).alias("days_outside"),
        S.strict_percentile(F.when(F.col("back") > 1, F.col("v")), F.col("now")).alias("p"),
    )
    side = F.when(F.col("now") < F.col("lo"), "por debajo").when(F.col("now") > F.col("hi"), "por encima").otherwise("dentro")
    judged = out.select("series", (F.col("days_outside") >= PERSISTENT).alias("active"), *S.rounded(vol=F.col("now") * 100, low=F.col("lo") * 100, high=F.col("hi") * 100, percentile=F.col("p")), side.alias("side"), "days_outside")
    short = F.when(F.col("active").isNull(), F.lit("insufficient history"))
    return bars.select("series").distinct().join(judged, "series", "left").withColumn("reason", short).withColumn("active", F.coalesce("active", F.lit(False)))


def calibration(bars: DataFrame, months: int = 24, least: int = 90) -> DataFrame:
    """How the last months' volatilities fall into the fixed quartiles, and where the cuts of the last REFERENCE_ROWS rows would be."""
    v = log_vol(bars, 30).withColumn("last", F.max("d").over(S.whole())).where("v IS NOT NULL")
    v = v.withColumn("back", F.row_number().over(S.whole().orderBy(F.desc("d")))).withColumn("label", S.bins(F.col("v"), VOL_CUTS, VOL_LABELS))
    recent = F.col("d") >= F.date_sub("last", months * 30)
    n = F.count_if(recent)
    share = {label: 100 * F.count_if(recent & (F.col("label") == label)) / n for label in VOL_LABELS}
    cuts = [F.percentile(F.when(F.col("back") <= REFERENCE_ROWS, F.col("v")), F.lit(q)).alias(f"cut{round(q * 100)}") for q in (0.25, 0.5, 0.75)]
    got = v.groupBy("series").agg(n.alias("n"), *[s.alias(f"share{k}") for k, s in enumerate(share.values())], *cuts).where(F.col("n") >= least)
    most = F.greatest(*[F.col(f"share{k}") for k in range(4)])
    dominant = F.coalesce(*[F.when(F.col(f"share{k}") == most, F.lit(label)) for k, label in enumerate(VOL_LABELS)])
    return got.select("series", "n", *S.rounded(**{f"share{k}": F.col(f"share{k}") for k in range(4)}, **{c: F.col(c) * 100 for c in ("cut25", "cut50", "cut75")}), dominant.alias("dominant"), (most > 50).alias("degenerate"), (most > 40).alias("unbalanced"))


def tails(bars: DataFrame, margin: float = 0.05, least: int = 60) -> DataFrame:
    """Ranges of the 30 rows that followed volatilities near the last one: of all times, and of the last REFERENCE_ROWS days."""
    w = S.rows(0, 30)
    x = log_vol(bars, 30).withColumn("r", F.when(F.count("*").over(w) == 31, F.max("close").over(w) / F.min("close").over(w) - 1))
    x = x.withColumns({"now": F.max_by("v", "d").over(S.whole()), "last": F.max("d").over(S.whole())})
    like = x.where(F.col("v").isNotNull() & F.col("r").isNotNull() & F.col("v").between(F.col("now") - margin, F.col("now") + margin))
    recent = F.when(F.col("d") >= F.date_sub("last", REFERENCE_ROWS), F.col("r"))
    got = like.groupBy("series").agg(F.count("*").alias("n_total"), F.count(recent).alias("n_recent"), *[F.percentile(c, F.lit(q)).alias(f"p{round(q * 100)}_{n}") for n, c in (("total", F.col("r")), ("recent", recent)) for q in (0.95, 0.5)])
    return got.where((F.col("n_total") >= least) & (F.col("n_recent") >= least)).select("series", "n_total", "n_recent", *S.rounded(**{c: F.col(c) * 100 for c in ("p95_total", "p95_recent", "p50_total", "p50_recent")}))


def terciles(bars: DataFrame, years: int = 6, least: int = 252) -> DataFrame:
    """The tercile of the last volatility within the last years, both ends included."""
    v = log_vol(bars, 30).withColumn("last", F.max("d").over(S.whole())).where("v IS NOT NULL")
    within = v.where(F.col("d").between(F.add_months("last", -12 * years), F.col("last")))
    got = within.groupBy("series", "last").agg(F.count("*").alias("n"), F.percentile("v", F.lit(1 / 3)).alias("a"), F.percentile("v", F.lit(2 / 3)).alias("b"), F.max_by("v", "d").alias("now")).where(F.col("n") >= least)
    label = F.when(F.col("now") < F.col("a"), TERCILES[0]).when(F.col("now") < F.col("b"), TERCILES[1]).otherwise(TERCILES[2])
    return got.select("series", F.col("last").alias("d"), "n", *S.rounded(vol=F.col("now"), low=F.col("a"), high=F.col("b")), label.alias("label"))
