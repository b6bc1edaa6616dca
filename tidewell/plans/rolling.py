"""Queries on bars with windows over rows: averages, ranges, volatility, drawdowns, pivots, triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import series as S
from tidewell.operators import levels, wilder
from tidewell.sources.market import BARS_SQL, METRIC_SQL, bars, metric

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _w(k: int) -> str:
    return f"(PARTITION BY series ORDER BY d ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def _sql_guarded(agg: str, x: str, k: int) -> str:
    return f"CASE WHEN count({x}) OVER {_w(k)} = {k} THEN {agg}({x}) OVER {_w(k)} END"


O = "(PARTITION BY series ORDER BY d)"  # noqa: E741
SO_FAR = "(PARTITION BY series ORDER BY d ROWS UNBOUNDED PRECEDING)"


@query(f"WITH {BARS_SQL} SELECT * FROM bars")
def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir)


@query(
    f"""WITH {BARS_SQL} SELECT series, CAST(date_trunc('week', d) AS DATE) + 6 AS d, arg_min(open, d) AS open, max(high) AS high, min(low) AS low,
    arg_max(close, d) AS close, sum(vol) AS vol FROM bars GROUP BY 1, 2"""
)
def bars_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.weekly(bars(spark, sf_dir))


@query(
    f"""WITH {BARS_SQL}, s AS (SELECT *, {_sql_guarded("avg", "close", 50)} AS a, {_sql_guarded("avg", "close", 200)} AS b FROM bars)
    SELECT series, d, round(a, 3) AS sma50, round(b, 3) AS sma200, round(a / lag(a, 20) OVER {O} - 1, 6) + 0 AS slope20,
    round(close / lag(close, 126) OVER {O} - 1, 6) + 0 AS momentum126, round(close / b, 6) AS mayer FROM s"""
)
def sma_slope_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bars(spark, sf_dir).withColumns({"a": S.sma(S.close(), 50), "b": S.sma(S.close(), 200)})
    a, b = F.col("a"), F.col("b")
    return s.select("series", "d", F.round("a", 3).alias("sma50"), F.round("b", 3).alias("sma200"), *S.rounded(slope20=S.change(a, 20), momentum126=S.change(S.close(), 126), mayer=S.close() / b))


TR_SQL = f"tr AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {O}), abs(low - lag(close) OVER {O})) AS tr FROM bars)"


@query(f"WITH {BARS_SQL}, {TR_SQL} SELECT series, d, round(tr, 2) AS tr, round({_sql_guarded('avg', 'tr', 14)}, 3) AS atr FROM tr")
def true_range_atr_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bars(spark, sf_dir).withColumn("tr", S.true_range(F.col("high"), F.col("low"), S.close()))
    return s.select("series", "d", F.round("tr", 2).alias("tr"), F.round(S.sma(F.col("tr"), 14), 3).alias("atr"))


ATR_SQL = f"""{TR_SQL},
n AS (SELECT *, row_number() OVER {O} AS i FROM tr),
seed AS (SELECT series, avg(tr) AS a FROM n WHERE i <= 14 GROUP BY series HAVING count(*) = 14),
w(series, i, a) AS (SELECT series, 14::BIGINT, a FROM seed UNION ALL SELECT w.series, w.i + 1, (w.a * 13 + n.tr) / 14 FROM w JOIN n ON n.series = w.series AND n.i = w.i + 1)"""


@query(f"WITH RECURSIVE {BARS_SQL}, {ATR_SQL} SELECT n.series, d, round(a, 3) AS atr FROM n LEFT JOIN w USING (series, i)")
def atr_wilder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wilder.atr(bars(spark, sf_dir)).select("series", "d", F.round("atr", 3).alias("atr"))


@query(
    f"""WITH RECURSIVE {BARS_SQL}, {ATR_SQL},
    x AS (SELECT n.series, d, a AS atr, CAST(date_trunc('week', d) AS DATE) + 6 AS week FROM n LEFT JOIN w USING (series, i)),
    k AS (SELECT series, week, arg_max(atr, d) AS atr, max(d) AS last FROM x WHERE atr IS NOT NULL GROUP BY 1, 2),
    p AS (SELECT *, lag(atr) OVER (PARTITION BY series ORDER BY week) AS before FROM k)
    SELECT x.series, x.d, x.d = p.last AS is_week_close, round(CASE WHEN x.d = p.last THEN p.atr ELSE p.before END, 3) AS weekly_atr
    FROM x LEFT JOIN p USING (series, week)"""
)
def weekly_atr_on_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wilder.weekly_on_daily(wilder.atr(bars(spark, sf_dir))).select("series", "d", "is_week_close", F.round("weekly_atr", 3).alias("weekly_atr"))


RET_SQL = f"r AS (SELECT *, close / lag(close) OVER {O} - 1 AS ret, ln(close / lag(close) OVER {O}) AS lret FROM bars)"


@query(
    f"""WITH {BARS_SQL}, {RET_SQL} SELECT series, d, round({_sql_guarded("stddev_samp", "ret", 30)} * sqrt(365), 6) AS vol30,
    round({_sql_guarded("stddev_samp", "lret", 30)} * sqrt(365), 6) AS log_vol30, round({_sql_guarded("stddev_samp", "ret", 90)} * sqrt(365), 6) AS vol90,
    round({_sql_guarded("stddev_pop", "ret", 30)}, 6) AS pop30 FROM r"""
)
def rolling_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bars(spark, sf_dir).withColumns({"ret": S.change(S.close()), "lret": F.log(S.close() / S.before(S.close()))})
    ret, lret = F.col("ret"), F.col("lret")
    return s.select("series", "d", *S.rounded(vol30=S.volatility(ret), log_vol30=S.volatility(lret), vol90=S.volatility(ret, 90), pop30=S.guarded(F.stddev_pop, ret, 30)))


@query(f"WITH {BARS_SQL} SELECT series, d, round(close / max(close) OVER {SO_FAR} - 1, 6) + 0 AS drawdown, close = max(close) OVER {SO_FAR} AS at_high FROM bars")
def drawdown_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("series", "d", *S.rounded(drawdown=S.drawdown(S.close())), (S.close() == F.max(S.close()).over(S.so_far())).alias("at_high"))


# Periods over which the deepest fall is reported.
PERIODS = [("early", "1995-03-01", "1996-02-28"), ("middle", "1997-06-01", "1998-08-31"), ("late", "2000-01-01", "2001-07-31"), ("none", "2003-01-01", "2003-12-31")]


@query(
    f"""WITH {BARS_SQL}, p(period, a, b) AS (VALUES {", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in PERIODS)}),
    x AS (SELECT period, series, close / max(close) OVER (PARTITION BY period, series ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM bars JOIN p ON d BETWEEN a AND b)
    SELECT period, series, count(*)::BIGINT AS days, round(min(dd), 4) AS deepest FROM x GROUP BY ALL HAVING count(*) >= 30"""
)
def drawdown_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.drawdown_by_period(bars(spark, sf_dir), PERIODS)


@query(
    f"""WITH {BARS_SQL}, x AS (SELECT *, min(close) OVER {_w(365)} AS lo, max(close) OVER {_w(365)} AS hi, count(*) OVER {_w(365)} AS n FROM bars)
    SELECT series, d, round(CASE WHEN hi > lo THEN (close - lo) / (hi - lo) * 100 END, 6) AS position FROM x WHERE n = 365"""
)
def range_position_365(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = S.trailing(365)
    x = bars(spark, sf_dir).withColumns({"lo": F.min(S.close()).over(w), "hi": F.max(S.close()).over(w), "n": F.count("*").over(w)})
    return x.where("n = 365").select("series", "d", *S.rounded(position=F.when(F.col("hi") > F.col("lo"), (S.close() - F.col("lo")) / (F.col("hi") - F.col("lo")) * 100)))


@query(
    f"""WITH {BARS_SQL}, {RET_SQL}, v AS (SELECT series, d, {_sql_guarded("stddev_samp", "ret", 90)} * sqrt(365) AS v FROM r),
    e AS (SELECT series, max(d) AS last, arg_max(v, d) AS now FROM v WHERE v IS NOT NULL GROUP BY series)
    SELECT series, last AS d, round(now, 6) AS vol90, round(avg((v < now)::INT) * 100, 6) AS percentile FROM v JOIN e USING (series) WHERE v IS NOT NULL AND d >= last - 1826 GROUP BY series, last, now"""
)
def vol_percentile_5y(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = bars(spark, sf_dir).withColumn("ret", S.change(S.close())).select("series", "d", S.volatility(F.col("ret"), 90).alias("v")).where("v IS NOT NULL")
    w = S.whole()
    x = v.withColumns({"last": F.max("d").over(w), "now": F.max_by("v", "d").over(w)}).where(F.col("d") >= F.date_sub("last", 1826))
    return x.groupBy("series", "last", "now").agg(S.strict_percentile(F.col("v"), F.col("now")).alias("p")).select("series", F.col("last").alias("d"), *S.rounded(vol90=F.col("now"), percentile=F.col("p")))


@query(
    f"""WITH {BARS_SQL}, {RET_SQL}, s AS (SELECT *, {_sql_guarded("stddev_samp", "ret", 60)} AS sigma FROM r),
    z AS (SELECT *, abs(ret) / lag(sigma) OVER {O} AS z FROM s), m AS (SELECT *, max(z) OVER {_w(5)} AS z5 FROM z)
    SELECT series, d, round(z, 6) AS z, round(z5, 6) AS z5 FROM m WHERE z5 >= 2"""
)
def extreme_move_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bars(spark, sf_dir).withColumn("ret", S.change(S.close())).withColumn("sigma", S.guarded(F.stddev_samp, F.col("ret"), 60))
    z = s.withColumn("z", F.abs("ret") / S.before(F.col("sigma"))).withColumn("z5", F.max("z").over(S.trailing(5)))
    return z.where("z5 >= 2").select("series", "d", *S.rounded(z=F.col("z"), z5=F.col("z5")))


AROUND = "(PARTITION BY series ORDER BY d ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)"
PIVOTS_SQL = f"""pv AS (
  SELECT series, d, 'high' AS kind, high AS price FROM bars QUALIFY count(*) OVER {AROUND} = 21 AND high = max(high) OVER {AROUND}
  UNION ALL SELECT series, d, 'low', low FROM bars QUALIFY count(*) OVER {AROUND} = 21 AND low = min(low) OVER {AROUND})"""


@query(f"WITH {BARS_SQL}, {PIVOTS_SQL} SELECT * FROM pv")
def swing_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.pivots(bars(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {BARS_SQL}, {PIVOTS_SQL},
    n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY price, d, kind) AS i FROM pv),
    z(series, i, low, last, zone) AS (
      SELECT series, i, price, price, 1 FROM n WHERE i = 1
      UNION ALL SELECT n.series, n.i, CASE WHEN n.price - z.last <= {levels.GAP} AND n.price - z.low <= {levels.SPAN} THEN z.low ELSE n.price END, n.price,
        CASE WHEN n.price - z.last <= {levels.GAP} AND n.price - z.low <= {levels.SPAN} THEN z.zone ELSE z.zone + 1 END
      FROM z JOIN n ON n.series = z.series AND n.i = z.i + 1)
    SELECT series, zone, round(avg(price), 2) AS center, min(price) AS low, max(price) AS high, count(*)::BIGINT AS touches,
      CASE WHEN count(*) FILTER (kind = 'high') >= count(*) FILTER (kind = 'low') THEN 'high' ELSE 'low' END AS kind, max(d) AS last_touch
    FROM z JOIN n USING (series, i) GROUP BY ALL HAVING count(*) >= 2"""
)
def price_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.zones(levels.pivots(bars(spark, sf_dir))).where("touches >= 2")


@query(
    f"""WITH RECURSIVE {BARS_SQL}, {PIVOTS_SQL},
    n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY price, d, kind) AS i FROM pv),
    z(series, i, low, last, zone) AS (
      SELECT series, i, price, price, 1 FROM n WHERE i = 1
      UNION ALL SELECT n.series, n.i, CASE WHEN n.price - z.last <= {levels.GAP} AND n.price - z.low <= {levels.SPAN} THEN z.low ELSE n.price END, n.price,
        CASE WHEN n.price - z.last <= {levels.GAP} AND n.price - z.low <= {levels.SPAN} THEN z.zone ELSE z.zone + 1 END
      FROM z JOIN n ON n.series = z.series AND n.i = z.i + 1),
    g AS (SELECT series, zone, round(avg(price), 2) AS center, min(price) AS low, max(price) AS high, count(*)::BIGINT AS touches FROM z JOIN n USING (series, i) GROUP BY ALL HAVING count(*) >= 2),
    e AS (SELECT series, arg_max(close, d) AS now FROM bars GROUP BY series),
    s AS (SELECT series, CASE WHEN high < now THEN 'support' ELSE 'resistance' END AS side, center, touches FROM g JOIN e USING (series) WHERE high < now OR low > now)
    SELECT series, side, row_number() OVER (PARTITION BY series, side ORDER BY CASE WHEN side = 'support' THEN -center ELSE center END)::INTEGER AS nearest, center, touches FROM s QUALIFY nearest <= 4"""
)
def nearest_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return levels.nearest(levels.zones(levels.pivots(b)).where("touches >= 2"), b)


@query(
    f"""WITH {BARS_SQL}, e AS (SELECT series, min(low) AS lo, (max(high) - min(low)) / 40 AS w FROM bars GROUP BY series HAVING count(*) >= 30),
    b AS (SELECT series, vol, least(floor((low - lo) / w), 39)::INT AS a, least(floor((high - lo) / w), 39)::INT AS z FROM bars JOIN e USING (series) WHERE w > 0),
    x AS (SELECT series, vol / (z - a + 1) AS v, unnest(range(a, z + 1)) AS bin FROM b),
    s AS (SELECT series, bin::INTEGER AS bin, sum(v) AS v FROM x GROUP BY ALL)
    SELECT series, bin, round(lo + bin * w, 2) AS low, round(lo + (bin + 1) * w, 2) AS high, round(100 * v / sum(v) OVER (PARTITION BY series), 6) AS share FROM s JOIN e USING (series)"""
)
def volume_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.volume_profile(bars(spark, sf_dir))


@query(
    f"""WITH {BARS_SQL}, e AS (SELECT series, max(d) AS last FROM bars GROUP BY series),
    x AS (SELECT series, m, high, low FROM bars JOIN e USING (series), (VALUES (3), (6), (12), (24), (1200)) t(m) WHERE d >= last - to_months(m))
    SELECT series, m::INTEGER AS months, CASE WHEN count(*) >= 5 THEN max(high) END AS high, CASE WHEN count(*) >= 5 THEN min(low) END AS low FROM x GROUP BY ALL"""
)
def period_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.period_levels(bars(spark, sf_dir))


@query(
    f"""WITH {BARS_SQL}, {METRIC_SQL},
    j AS (SELECT series, d, close, value FROM bars LEFT JOIN metric USING (series, d)),
    f AS (SELECT series, d, close, last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS v FROM j),
    r AS (SELECT series, d, ln(close / lag(close) OVER {O}) AS x, ln(nullif(v, 0) / nullif(lag(v) OVER {O}, 0)) AS y FROM f),
    p AS (SELECT series, d, CASE WHEN y IS NOT NULL THEN x END AS x, CASE WHEN x IS NOT NULL THEN y END AS y FROM r),
    c AS (SELECT series, d, CASE WHEN count(x) OVER {_w(180)} = 180 THEN covar_pop(x, y) OVER {_w(180)} / nullif(stddev_pop(x) OVER {_w(180)} * stddev_pop(y) OVER {_w(180)}, 0) END AS c FROM p)
    SELECT series, d, round(c, 6) AS correlation, CASE WHEN c < 0.2 THEN 'baja' WHEN c < 0.4 THEN 'media' WHEN c IS NOT NULL THEN 'alta' END AS tranche FROM c"""
)
def rolling_corr_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = bars(spark, sf_dir).join(metric(spark, sf_dir), ["series", "d"], "left").select("series", "d", "close", "value")
    f = j.withColumn("v", S.filled(F.col("value"), 5))
    positive = lambda x: F.when(x != 0, x)
    r = f.withColumns({"x": F.log(S.close() / S.before(S.close())), "y": F.log(positive(F.col("v")) / positive(S.before(F.col("v"))))})
    c = r.withColumn("c", S.correlation(F.col("x"), F.col("y"), 180))
    return c.select("series", "d", *S.rounded(correlation=F.col("c")), S.bins(F.col("c"), [0.2, 0.4], ["baja", "media", "alta"]).alias("tranche"))


@query(
    f"""WITH {BARS_SQL}, {METRIC_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY series) AS all_rows FROM bars)
    SELECT b.series, b.d, m.d AS metric_d, round(m.value, 6) AS value FROM bars b ASOF LEFT JOIN metric m ON b.series = m.series AND b.d >= m.d"""
)
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.asof(bars(spark, sf_dir).select("series", "d"), metric(spark, sf_dir)).select("series", "d", F.col("m.d").alias("metric_d"), *S.rounded(value=F.col("m.value")))


@query(
    f"""WITH {BARS_SQL}, {METRIC_SQL}
    SELECT b.series, b.d, m.d AS metric_d, round(m.value, 6) AS value FROM bars b ASOF LEFT JOIN metric m ON b.series = m.series AND b.d > m.d"""
)
def asof_strict_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.asof(bars(spark, sf_dir).select("series", "d"), metric(spark, sf_dir), strict=True).select("series", "d", F.col("m.d").alias("metric_d"), *S.rounded(value=F.col("m.value")))


@query(
    f"""WITH {BARS_SQL}, {METRIC_SQL},
    m AS (SELECT *, last_value(value IGNORE NULLS) OVER {SO_FAR} AS p FROM metric),
    x AS (SELECT series, d, value, p, CASE WHEN count(value) OVER {_w(7)} = 7 THEN avg(value) OVER {_w(7)} END AS ma7, CASE WHEN count(*) OVER {SO_FAR} >= 365 THEN stddev_samp(value) OVER {SO_FAR} END AS sd, p / nullif(lag(p, 60) OVER {O}, 0) - 1 AS change60 FROM m)
    SELECT series, d, round(ma7, 6) AS ma7, round(ma7 / nullif(lag(ma7, 20) OVER {O}, 0) - 1, 6) + 0 AS ma7_delta20, round(sd, 6) AS expanding_sd, round(change60, 6) + 0 AS change60,
    CASE WHEN change60 IS NULL THEN NULL WHEN change60 > 0.05 THEN 'up' WHEN change60 < -0.05 THEN 'down' ELSE 'flat' END AS trend FROM x"""
)
def onchain_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    over = lambda x, k: x / F.when(S.before(x, k) != 0, S.before(x, k)) - 1
    m = metric(spark, sf_dir).withColumns({"p": S.filled(v), "ma7": S.sma(v, 7)})
    x = m.withColumns({"sd": F.when(F.count("*").over(S.so_far()) >= 365, F.stddev_samp("value").over(S.so_far())), "c": over(F.col("p"), 60)})
    trend = F.when(F.col("c") > 0.05, "up").when(F.col("c") < -0.05, "down").when(F.col("c").isNotNull(), "flat")
    return x.select("series", "d", *S.rounded(ma7=F.col("ma7"), ma7_delta20=over(F.col("ma7"), 20), expanding_sd=F.col("sd"), change60=F.col("c")), trend.alias("trend"))
