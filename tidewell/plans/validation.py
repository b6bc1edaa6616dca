"""Queries on calendars and on the validation of masks against forward returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import series as S
from tidewell.operators import calendar, nulls, quantile, stats
from tidewell.plans.rolling import O, SO_FAR, _sql_guarded
from tidewell.sources.market import AGENDA_DAYS, BARS_SQL, METRIC_SQL, bars, metric, moved_days, moved_days_sql, table

QUERIES, SQL = {}, {}
#: Rows ahead of the return; rotations of a p-value, and of a gate's threshold.
AHEAD, DRAWS, GATE_DRAWS = 30, nulls.unit_draws(2000, 0), nulls.unit_draws(300, 46)
#: Shuffles of the episodes.
SHUFFLES = 2000


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


DAYS_SQL = "days AS (SELECT series, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM bars GROUP BY series)"
MISSING_SQL = f"{DAYS_SQL}, missing AS (SELECT series, d FROM days ANTI JOIN bars USING (series, d))"
RUNS_SQL = f"""{MISSING_SQL}, runs AS (SELECT series, min(d) AS a, max(d) AS z, count(*) AS n FROM (SELECT series, d, d - row_number() OVER {O}::INTEGER AS i FROM missing) GROUP BY series, i)"""


@query(f"WITH {BARS_SQL}, {MISSING_SQL} SELECT * FROM missing")
def calendar_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return calendar.missing(calendar.days(b), b)


@query(f"WITH {BARS_SQL}, {RUNS_SQL} SELECT * FROM runs")
def gap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return calendar.runs(calendar.missing(calendar.days(b), b))


@query(
    f"""WITH {BARS_SQL}, {DAYS_SQL}, j AS (SELECT series, d, close FROM days LEFT JOIN bars USING (series, d))
    SELECT series, d, last_value(close IGNORE NULLS) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS filled2, last_value(close IGNORE NULLS) OVER {SO_FAR} AS filled, close IS NULL AS was_missing FROM j"""
)
def ffill_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = calendar.reindexed(bars(spark, sf_dir).select("series", "d", "close"))
    return x.select("series", "d", S.filled(S.close(), 2).alias("filled2"), S.filled(S.close()).alias("filled"), S.close().isNull().alias("was_missing"))


@query(
    f"""WITH {BARS_SQL}, {DAYS_SQL}, w AS (SELECT *, row_number() OVER {O} AS i FROM days WHERE isodow(d) < 6), g AS (SELECT * FROM w ANTI JOIN bars USING (series, d)),
    l AS (SELECT series, max(n) AS longest FROM (SELECT series, count(*) AS n FROM (SELECT series, i - row_number() OVER {O} AS k FROM g) GROUP BY series, k) GROUP BY series),
    c AS (SELECT w.series, count(*) AS expected, count(g.d) AS missing FROM w LEFT JOIN g ON g.series = w.series AND g.d = w.d GROUP BY w.series)
    SELECT series, expected, missing, round(1 - missing / expected, 6) AS coverage, coalesce(longest, 0)::BIGINT AS longest FROM c LEFT JOIN l USING (series)"""
)
def business_day_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return calendar.continuity(b, calendar.business_days(b))


@query(f"WITH {BARS_SQL}, {RUNS_SQL} SELECT DISTINCT b.series, b.d FROM bars b JOIN runs r ON b.series = r.series AND n >= 3 AND b.d BETWEEN a AND z + 20")
def gap_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.nulled_days(bars(spark, sf_dir))


MASK_SQL = f"""{METRIC_SQL},
q AS (SELECT *, quantile_cont(value, 0.8) OVER (PARTITION BY series ORDER BY d RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS th, min(d) OVER (PARTITION BY series) AS first FROM metric),
mask AS (SELECT series, d, value, value > th AS m FROM q WHERE th IS NOT NULL AND d >= first + 365)"""
RET_SQL = f"ret AS (SELECT series, d, lead(close, {AHEAD}) OVER {O} / close - 1 AS r FROM bars), z AS (SELECT series, d, m, r FROM mask JOIN ret USING (series, d) WHERE r IS NOT NULL)"


def masked_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mask(metric(spark, sf_dir)).join(stats.forward_returns(bars(spark, sf_dir), AHEAD), ["series", "d"])


@query(f"WITH {MASK_SQL} SELECT series, d, m FROM mask")
def rolling_quantile_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mask(metric(spark, sf_dir)).select("series", "d", "m")


EPISODES_SQL = f"""e AS (SELECT series, d, CASE WHEN d - lag(d) OVER {O} <= 30 THEN 0 ELSE 1 END AS new FROM mask WHERE m),
f AS (SELECT *, sum(new) OVER {SO_FAR} AS episode FROM e), episodes AS (SELECT series, episode::INTEGER AS episode, min(d) AS a, max(d) AS z, count(*) AS n FROM f GROUP BY ALL)"""


@query(f"WITH {MASK_SQL}, {EPISODES_SQL} SELECT * FROM episodes")
def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.episodes(stats.mask(metric(spark, sf_dir)).where("m").select("series", "d"))


@query(
    f"""WITH {BARS_SQL}, {MASK_SQL}, {EPISODES_SQL}, {RUNS_SQL}, bad AS (SELECT DISTINCT b.series, b.d FROM bars b JOIN runs r ON b.series = r.series AND n >= 3 AND b.d BETWEEN a AND z + 20)
    SELECT series, episode, a, z FROM episodes e WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.series = e.series AND bad.d BETWEEN e.a AND e.z)"""
)
def clean_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = episodes(spark, sf_dir).select("series", "episode", "a", "z")
    bad = gap_propagation(spark, sf_dir).select(F.col("series").alias("s"), F.col("d").alias("bad"))
    return found.join(bad, (F.col("series") == F.col("s")) & F.col("bad").between(F.col("a"), F.col("z")), "left_anti")


SEGMENTS_SQL = """ends AS (SELECT series, min(d) AS first, max(d) AS last FROM z GROUP BY series),
k AS (SELECT series, first, last, unnest([1, 2, 3, 4]) AS segment FROM ends),
segments AS (SELECT series, segment, first + round_even((last - first) * (segment - 1) / 4, 0)::INTEGER AS a, first + round_even((last - first) * segment / 4, 0)::INTEGER - CASE WHEN segment = 4 THEN 0 ELSE 1 END AS e FROM k)"""


@query(f"WITH {BARS_SQL}, {MASK_SQL}, {RET_SQL}, {SEGMENTS_SQL} SELECT series, segment, a, e AS z FROM segments")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.segments(masked_returns(spark, sf_dir))


@query(
    f"""WITH {BARS_SQL}, c AS (SELECT series, min(d) + ((max(d) - min(d)) // 2)::INTEGER AS cut FROM bars GROUP BY series),
    x AS (SELECT series, cut, count(*) FILTER (d <= cut) AS n1, count(*) FILTER (d > cut) AS n2, coalesce(max(d) FILTER (d <= cut) - min(d) FILTER (d <= cut), 0) / 365.25 AS y1, coalesce(max(d) FILTER (d > cut) - min(d) FILTER (d > cut), 0) / 365.25 AS y2 FROM bars JOIN c USING (series) GROUP BY ALL)
    SELECT series, cut, n1, n2, round(y1, 2)::DOUBLE AS years1, round(y2, 2)::DOUBLE AS years2, y1 >= 2 AND y2 >= 2 AS enough FROM x"""
)
def partition_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.halves(bars(spark, sf_dir))


@query(
    f"""WITH {BARS_SQL}, l AS (SELECT series, max(d) AS z FROM bars GROUP BY series), b AS (SELECT series, z, unnest([1, 2, 3, 4, 5]) AS block FROM l)
    SELECT series, block, z + 1 + (block - 1) * 91 AS a, z + 91 * block AS "end", z + 61 + (block - 1) * 91 AS last_eligible FROM b"""
)
def forward_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.forward_blocks(bars(spark, sf_dir).groupBy("series").agg(F.max("d").alias("z")))


@query(
    f"""WITH {BARS_SQL}, m AS (SELECT series, (max(d) - min(d)) / greatest(count(*) - 1, 1) AS x FROM bars GROUP BY series)
    SELECT series, round(x, 6) AS mean_days, CASE WHEN x > 20 THEN 'monthly' WHEN x > 5 THEN 'weekly' ELSE 'daily' END AS frequency FROM m"""
)
def frequency_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.frequency(bars(spark, sf_dir))


@query(
    f"""WITH d AS ({moved_days_sql(6000, 9500)}),
    x AS (SELECT d, list_max(list_filter([{", ".join(f"DATE '{h}'" for h in calendar.HALVINGS)}], lambda h: h <= d)) AS halving FROM d), y AS (SELECT *, (d - halving)::INTEGER AS since FROM x),
    s AS (SELECT *, CASE WHEN since IS NULL OR since < 455 OR since > 730 THEN 'silencio' WHEN since < 545 THEN 'aproximandose' ELSE 'en_ventana' END AS state FROM y)
    SELECT d, halving, since, state, CASE WHEN state <> 'silencio' THEN greatest(545 - since, 0) END AS days_to_window, CASE WHEN state <> 'silencio' THEN greatest(730 - since, 0) END AS days_left FROM s"""
)
def halving_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phase on each day of the orders, moved to 2011 and on, and to 2021 and on."""
    return calendar.halving_phase(moved_days(spark, sf_dir, 6000, 9500))


@query(
    f"""WITH d AS ({moved_days_sql(AGENDA_DAYS)}), e(d, kind, weight) AS (VALUES {", ".join(f"(DATE '{d}', 'FOMC', '{'alta' if b else 'media'}')" for d, b in calendar.FOMC)}, {", ".join(f"(DATE '{d}', 'CPI', 'alta')" for d in calendar.CPI)}),
    n AS (SELECT d.d AS today, e.d, kind, weight, (e.d - d.d)::INTEGER AS days FROM d JOIN e ON e.d >= d.d QUALIFY row_number() OVER (PARTITION BY d.d ORDER BY e.d, kind) <= 6) SELECT * FROM n WHERE days <= 90"""
)
def event_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies ahead on each day of the orders, moved to where the events are."""
    days = moved_days(spark, sf_dir, AGENDA_DAYS).withColumnRenamed("d", "today")
    return calendar.agenda(calendar.events(spark), days)


@query(
    """WITH x AS (SELECT event_type AS series, CAST(ts AS DATE) AS d, round(value * 100)::BIGINT AS v, ts FROM events),
    e AS (SELECT series, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM x GROUP BY series),
    s AS (SELECT series, d, sum(v)::BIGINT AS total, arg_max(v, ts)::BIGINT AS last FROM x GROUP BY ALL)
    SELECT series, d, coalesce(total, 0)::BIGINT AS total, last_value(last IGNORE NULLS) OVER (PARTITION BY series ORDER BY d ROWS UNBOUNDED PRECEDING)::BIGINT AS last FROM e LEFT JOIN s USING (series, d)"""
)
def resample_to_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.to_date("ts").alias("d"), F.round(F.col("value") * 100).cast("long").alias("v"), "ts")
    daily = x.groupBy("series", "d").agg(F.sum("v").alias("total"), F.max_by("v", "ts").alias("last"))
    return calendar.reindexed(daily).select("series", "d", F.coalesce("total", F.lit(0)).alias("total"), S.filled(F.col("last")).alias("last"))


@query(
    f"""WITH {MASK_SQL}, c AS (SELECT *, CASE WHEN m = lag(m) OVER {O} THEN 0 ELSE 1 END AS new FROM mask), n AS (SELECT *, sum(new) OVER {SO_FAR} AS run FROM c)
    SELECT series, m, min(d) AS a, count(*) AS n FROM n GROUP BY series, run, m"""
)
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.runs(stats.mask(metric(spark, sf_dir)))


THETA = "quantile_cont(r, 0.5) FILTER (m) - quantile_cont(r, 0.5) FILTER (NOT m)"


@query(f"WITH {BARS_SQL}, {MASK_SQL}, {RET_SQL} SELECT series, count(*) AS n, count(*) FILTER (m) AS masked, round({THETA}, 6) + 0 AS theta FROM z GROUP BY series")
def forward_return_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_returns(spark, sf_dir).groupBy("series").agg(F.count("*").alias("n"), F.count_if("m").alias("masked"), F.round(stats.theta(), 6).alias("theta"))


@query(
    f"""WITH {BARS_SQL}, {MASK_SQL}, y AS (SELECT series, d, lead(close, 30) OVER {O} / close - 1 AS fwd, close / lag(close, 30) OVER {O} - 1 AS bwd FROM bars),
    j AS (SELECT series, m, fwd, bwd FROM mask JOIN y USING (series, d)),
    t AS (SELECT series, {THETA.replace("(r,", "(fwd,")} AS f, {THETA.replace("(r,", "(bwd,")} AS b FROM j GROUP BY series), c AS (SELECT *, abs(f) / nullif(abs(b), 0) AS c FROM t)
    SELECT series, round(f, 6) AS theta_forward, round(b, 6) AS theta_backward, round(c, 6) AS ratio, CASE WHEN c IS NULL THEN 'not evaluable' WHEN c > 1.2 THEN 'forward' WHEN c < 0.8 THEN 'backward' ELSE 'tie' END AS reading FROM c"""
)
def lead_lag_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = bars(spark, sf_dir).select("series", "d", (S.after(S.close(), 30) / S.close() - 1).alias("fwd"), S.change(S.close(), 30).alias("bwd"))
    t = stats.mask(metric(spark, sf_dir)).join(y, ["series", "d"]).groupBy("series").agg(stats.theta("fwd").alias("f"), stats.theta("bwd").alias("b"))
    c = t.withColumn("c", F.abs("f") / F.when(F.col("b") != 0, F.abs("b")))
    reading = F.when(F.col("c").isNull(), "not evaluable").when(F.col("c") > 1.2, "forward").when(F.col("c") < 0.8, "backward").otherwise("tie")
    return c.select("series", *S.rounded(theta_forward=F.col("f"), theta_backward=F.col("b"), ratio=F.col("c")), reading.alias("reading"))


SPEARMAN_SQL = f"""{SEGMENTS_SQL}, g AS (SELECT z.series, segment, m::INT AS m, r FROM z JOIN segments s ON z.series = s.series AND z.d BETWEEN s.a AND s.e),
w AS (SELECT series, segment, rank() OVER (PARTITION BY series, segment ORDER BY m) + (count(*) OVER (PARTITION BY series, segment, m) - 1) / 2 AS x, rank() OVER (PARTITION BY series, segment ORDER BY r) + (count(*) OVER (PARTITION BY series, segment, r) - 1) / 2 AS y FROM g),
rho AS (SELECT series, segment, count(*) AS n, CASE WHEN count(*) >= 3 THEN covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) END AS rho FROM w GROUP BY ALL)"""


def _segment_rhos(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = calendar.in_segments(masked_returns(spark, sf_dir)).withColumn("m", F.col("m").cast("int"))
    return stats.spearman(z, "m", "r", ["series", "segment"])


@query(f"WITH {BARS_SQL}, {MASK_SQL}, {RET_SQL}, {SPEARMAN_SQL} SELECT series, segment, n, round(rho, 6) AS rho FROM rho")
def segment_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segment_rhos(spark, sf_dir).select("series", "segment", "n", *S.rounded(rho=F.col("rho")))


@query(
    f"""WITH {BARS_SQL}, {MASK_SQL}, {RET_SQL}, {SPEARMAN_SQL} SELECT series, CASE WHEN count(rho) = 4 THEN round(abs(quantile_cont(rho, 0.5)), 6) END AS statistic,
    coalesce(count(rho) = 4 AND min(sign(rho)) = max(sign(rho)) AND min(sign(rho)) <> 0, false) AS one_sign FROM rho GROUP BY series"""
)
def sign_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.signum("rho")
    all_of = F.count("rho") == 4
    one = F.coalesce(all_of & (F.min(sign) == F.max(sign)) & (F.min(sign) != 0), F.lit(False))
    return _segment_rhos(spark, sf_dir).groupBy("series").agg(F.when(all_of, F.round(F.abs(F.percentile("rho", F.lit(0.5))), 6)).alias("statistic"), one.alias("one_sign"))


_BASE = ["mayer", "vol30", "mom30"]


def _r2_sql(by: str = "series") -> str:
    names = [*_BASE, "m", "r"]
    k = len(names)
    steps, last = [], "c0"
    head = ", ".join(f"covar_pop({names[i]}, {names[j]}) AS s{i}_{j}" for i in range(k) for j in range(i + 1))
    steps.append(f"c0 AS (SELECT {by}, count(*) AS n, {head} FROM x GROUP BY {by})")
    for j in range(k):
        left = lambda i, j=j: f"(s{i}_{j}" + "".join(f" - l{i}_{m} * l{j}_{m}" for m in range(j)) + ")"
        steps.append(f"d{j} AS (SELECT *, sqrt(CASE WHEN {left(j)} > 1e-18 THEN {left(j)} END) AS l{j}_{j} FROM {last})")
        more = "".join(f", {left(i)} / l{j}_{j} AS l{i}_{j}" for i in range(j + 1, k))
        steps.append(f"c{j + 1} AS (SELECT *{more} FROM d{j})")
        last = f"c{j + 1}"
    y = k - 1
    base = " + ".join(f"l{y}_{m} * l{y}_{m}" for m in range(len(_BASE)))
    return f"{', '.join(steps)} SELECT {by}, n, round(({base}) / s{y}_{y}, 6) AS r2, round(100 * l{y}_{y - 1} * l{y}_{y - 1} / s{y}_{y}, 5) AS gain FROM {last}"


def _with_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = bars(spark, sf_dir).withColumn("ret", S.change(S.close()))
    b = p.select("series", "d", (S.close() / S.sma(S.close(), 200)).alias("mayer"), S.guarded(F.stddev_samp, F.col("ret"), 30).alias("vol30"), S.change(S.close(), 30).alias("mom30"))
    return masked_returns(spark, sf_dir).join(b, ["series", "d"]).dropna(subset=_BASE)


@query(
    f"""WITH {BARS_SQL}, {MASK_SQL}, {RET_SQL}, p AS (SELECT *, close / lag(close) OVER {O} - 1 AS ret FROM bars),
    b AS (SELECT series, d, close / {_sql_guarded("avg", "close", 200)} AS mayer, {_sql_guarded("stddev_samp", "ret", 30)} AS vol30, close / lag(close, 30) OVER {O} - 1 AS mom30 FROM p),
    x AS (SELECT series, m::INT::DOUBLE AS m, r, mayer, vol30, mom30 FROM z JOIN b USING (series, d) WHERE mayer IS NOT NULL AND vol30 IS NOT NULL AND mom30 IS NOT NULL), {_r2_sql()}"""
)
def delta_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _with_base(spark, sf_dir).withColumn("m", F.col("m").cast("int"))
    return stats.incremental_r2(x, _BASE, "m", "r").select("series", "n", F.round("r2", 6).alias("r2"), F.round("gain", 5).alias("gain"))


PLACED_SQL = f"i AS (SELECT series, d, m, r, row_number() OVER {O} - 1 AS i, count(*) OVER (PARTITION BY series) AS l FROM z)"
ROTATED_SQL = f"""{PLACED_SQL},
draws AS (SELECT unnest(range({len(DRAWS)}))::INTEGER AS k, unnest({DRAWS}::DOUBLE[]) AS u),
t AS (SELECT series, k, m, (i + 30 + floor(u * (l - 59))::BIGINT) % l AS i FROM i, draws WHERE l > 60),
rot AS (SELECT t.series, t.k, t.m, i.r FROM t JOIN i ON t.series = i.series AND t.i = i.i)"""
REAL_SQL = f"e AS (SELECT series, {THETA} AS theta FROM z GROUP BY series)"


def _share(test: str) -> str:
    return f"round(avg(({test})::INT), 6)"


@query(
    f"""WITH {BARS_SQL}, {MASK_SQL}, {RET_SQL}, {ROTATED_SQL}, n AS (SELECT series, k, {THETA} AS t FROM rot GROUP BY ALL), {REAL_SQL}
    SELECT series, round(theta, 6) + 0 AS theta, count(t) AS n, {_share("t >= theta")} AS p_positive, {_share("t <= theta")} AS p_negative, {_share("abs(t) >= abs(theta)")} AS p_both FROM n JOIN e USING (series) GROUP BY series, theta"""
)
def rotation_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = nulls.rotation_p_values(masked_returns(spark, sf_dir), DRAWS)
    return p.select("series", "n", *S.rounded(**{c: F.col(c) for c in ("theta", "p_positive", "p_negative", "p_both")}))


GATE_SQL = f"""draws AS (SELECT unnest(range({len(GATE_DRAWS)}))::INTEGER AS k, unnest({GATE_DRAWS}::DOUBLE[]) AS u)"""


@query(
    f"""WITH {BARS_SQL}, {MASK_SQL}, {RET_SQL}, {SPEARMAN_SQL}, {GATE_SQL},
    h AS (SELECT series, segment, m, rank() OVER (PARTITION BY series, segment ORDER BY r) + (count(*) OVER (PARTITION BY series, segment, r) - 1) / 2 AS y, row_number() OVER (PARTITION BY series ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY series) AS l
      FROM (SELECT z.series, z.d, segment, m::INT AS m, r FROM z JOIN segments s ON z.series = s.series AND z.d BETWEEN s.a AND s.e)),
    t AS (SELECT series, k, m, (i + 1 + floor(u * (l - 1))::BIGINT) % l AS i FROM h, draws WHERE l > 1),
    c AS (SELECT t.series, k, segment, CASE WHEN count(*) >= 3 THEN covar_pop(t.m, y) / nullif(stddev_pop(t.m) * stddev_pop(y), 0) END AS rho FROM t JOIN h ON t.series = h.series AND t.i = h.i GROUP BY ALL),
    n AS (SELECT series, k, CASE WHEN count(rho) = 4 THEN abs(quantile_cont(rho, 0.5)) END AS t FROM c GROUP BY ALL),
    x AS (SELECT series, count(t) AS n, quantile_cont(t, 0.95) AS threshold FROM n WHERE t IS NOT NULL GROUP BY series HAVING count(t) >= 150),
    o AS (SELECT series, CASE WHEN count(rho) = 4 THEN abs(quantile_cont(rho, 0.5)) END AS t FROM rho GROUP BY series)
    SELECT series, n, round(threshold, 6) AS threshold, round(t, 6) AS statistic, coalesce(t >= threshold, false) AS passes FROM x JOIN o USING (series)"""
)
def gate_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median rank correlation of mask and return over four segments against its rotations."""
    z = calendar.in_segments(masked_returns(spark, sf_dir))
    real = _segment_rhos(spark, sf_dir).groupBy("series").agg(F.when(F.count("rho") == 4, F.abs(F.percentile("rho", F.lit(0.5)))).alias("t"))
    limit = nulls.threshold(nulls.segment_rho_null(z, GATE_DRAWS, 4), "t", len(GATE_DRAWS))
    return limit.join(real, "series").select("series", "n", *S.rounded(threshold=F.col("threshold"), statistic=F.col("t")), F.coalesce(F.col("t") >= F.col("threshold"), F.lit(False)).alias("passes"))


@query(
    f"""WITH {BARS_SQL}, {MASK_SQL}, {RET_SQL}, {PLACED_SQL}, {GATE_SQL}, t AS (SELECT series, k, m, (i + 1 + floor(u * (l - 1))::BIGINT) % l AS i FROM i, draws WHERE l > 1),
    n AS (SELECT t.series, k, abs({THETA.replace("(m)", "(t.m)").replace("NOT m", "NOT t.m")}) AS t FROM t JOIN i ON t.series = i.series AND t.i = i.i GROUP BY ALL)
    SELECT series, count(t) AS n, round(quantile_cont(t, 0.95), 6) AS threshold FROM n WHERE t IS NOT NULL GROUP BY series HAVING count(t) >= {len(GATE_DRAWS) // 2}"""
)
def rotation_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile of the effect's size over rotations by 1 to rows - 1."""
    rows = nulls.gathered(masked_returns(spark, sf_dir)).where("l > 1")
    null = nulls.dealt(rows, nulls.shifts(GATE_DRAWS, F.lit(1), F.col("l") - 1), "s").select("series", F.abs(nulls.effect(F.col("s"))).alias("t"))
    return nulls.threshold(null, "t", len(GATE_DRAWS)).select("series", "n", *S.rounded(threshold=F.col("threshold")))


_R2_FIELDS = ", ".join(f"o.{c}" for c in _BASE)


@query(
    f"""WITH {BARS_SQL}, {MASK_SQL}, {RET_SQL}, p AS (SELECT *, close / lag(close) OVER {O} - 1 AS ret FROM bars),
    b AS (SELECT series, d, close / {_sql_guarded("avg", "close", 200)} AS mayer, {_sql_guarded("stddev_samp", "ret", 30)} AS vol30, close / lag(close, 30) OVER {O} - 1 AS mom30 FROM p), {GATE_SQL},
    h AS (SELECT series, m::INT::DOUBLE AS m, r, mayer, vol30, mom30, row_number() OVER {O} - 1 AS i, count(*) OVER (PARTITION BY series) AS l FROM z JOIN b USING (series, d) WHERE mayer IS NOT NULL AND vol30 IS NOT NULL AND mom30 IS NOT NULL),
    t AS (SELECT series, k, m, (i + 1 + floor(u * (l - 1))::BIGINT) % l AS i FROM h, draws WHERE l > 1), x AS (SELECT t.series, k, t.m, o.r, {_R2_FIELDS} FROM t JOIN h o ON o.series = t.series AND o.i = t.i),
    n AS (WITH {_r2_sql("series, k")}) SELECT series, count(gain) AS n, round(quantile_cont(gain, 0.95), 4) AS threshold FROM n WHERE gain IS NOT NULL GROUP BY series HAVING count(gain) >= 150"""
)
def gate_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile, over rotations, of what a mask adds to R2."""
    null = nulls.gain_null(_with_base(spark, sf_dir), GATE_DRAWS, _BASE, "r").withColumn("t", F.round("t", 5))
    limit = nulls.threshold(null, "t", len(GATE_DRAWS))
    return limit.select("series", "n", F.round("threshold", 4).alias("threshold"))


TERCILES_SQL = f"""lr AS (SELECT series, d, ln(close / lag(close) OVER {O}) AS x FROM bars), lv AS (SELECT series, d, {_sql_guarded("stddev_samp", "x", 30)} AS v FROM lr),
pq AS (SELECT *, CASE WHEN count(v) OVER w = 365 THEN quantile_cont(v, 1.0::DOUBLE / 3) OVER w END AS q1, CASE WHEN count(v) OVER w = 365 THEN quantile_cont(v, 2.0::DOUBLE / 3) OVER w END AS q2
  FROM lv WINDOW w AS (PARTITION BY series ORDER BY d ROWS BETWEEN 365 PRECEDING AND 1 PRECEDING)),
terciles AS (SELECT series, d, CASE WHEN q1 IS NULL OR v IS NULL THEN NULL WHEN v > q2 THEN 2 WHEN v > q1 THEN 1 ELSE 0 END AS t FROM pq)"""


@query(f"WITH {BARS_SQL}, {TERCILES_SQL} SELECT series, d, t FROM terciles")
def past_terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nulls.past_terciles(bars(spark, sf_dir))


@query(
    f"""WITH {BARS_SQL}, {MASK_SQL}, {RET_SQL}, {TERCILES_SQL}, i AS (SELECT series, d, m, r, t, row_number() OVER {O} - 1 AS i, count(*) OVER (PARTITION BY series) AS l FROM z LEFT JOIN terciles USING (series, d)),
    g AS (SELECT series, l, count(*) AS n, {", ".join(f"count(*) FILTER (t = {x}) / count(*) AS b{x}" for x in (0, 1, 2))} FROM i WHERE m AND l > 60 GROUP BY ALL),
    s AS (SELECT series, l, unnest(range(30, l - 29)) AS s FROM g), p AS (SELECT i.series, s, (i + s) % s.l AS i FROM i JOIN s ON i.series = s.series WHERE m),
    c AS (SELECT p.series, s, {", ".join(f"count(*) FILTER (t = {x}) / count(*) AS c{x}" for x in (0, 1, 2))} FROM p JOIN i ON i.series = p.series AND i.i = p.i GROUP BY ALL),
    a AS (SELECT c.series, s, l FROM c JOIN g USING (series) WHERE greatest(abs(c0 - b0), abs(c1 - b1), abs(c2 - b2)) <= 0.1::DOUBLE),
    n AS (SELECT a.series, s, {THETA.replace("(r,", "(o.r,").replace("(m)", "(i.m)").replace("NOT m", "NOT i.m")} AS t FROM a JOIN i ON i.series = a.series JOIN i o ON o.series = i.series AND o.i = (i.i + s) % a.l GROUP BY ALL), {REAL_SQL},
    x AS (SELECT g.series, theta, count(s) AS k, {_share("t >= theta")} AS p_positive, {_share("t <= theta")} AS p_negative FROM g JOIN e USING (series) LEFT JOIN n ON n.series = g.series GROUP BY ALL)
    SELECT series, k AS n_admissible, k >= 200 AS evaluable, round(theta, 6) + 0 AS theta, CASE WHEN k >= 200 THEN p_positive END AS p_positive, CASE WHEN k >= 200 THEN p_negative END AS p_negative FROM x"""
)
def restricted_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotations that leave the masked days' shares of the volatility terciles (against the past) as they are."""
    z = masked_returns(spark, sf_dir).join(nulls.past_terciles(bars(spark, sf_dir)), ["series", "d"], "left")
    p = nulls.restricted_p_values(z)
    return p.select("series", "n_admissible", "evaluable", *S.rounded(**{c: F.col(c) for c in ("theta", "p_positive", "p_negative")}))


@query(
    f"""WITH {BARS_SQL}, {MASK_SQL}, {RET_SQL}, {PLACED_SQL}, g AS (SELECT series, l, count(*) FILTER (m) AS n FROM i GROUP BY ALL HAVING count(*) FILTER (m) > 0 AND count(*) FILTER (NOT m) > 0),
    s AS (SELECT series, n, unnest(range(0, greatest(1, l - n))) AS s FROM g),
    b AS (SELECT i.series, s, quantile_cont(r, 0.5) FILTER (i BETWEEN s AND s + n - 1) - quantile_cont(r, 0.5) FILTER (NOT i BETWEEN s AND s + n - 1) AS t FROM i JOIN s ON i.series = s.series GROUP BY ALL), {REAL_SQL}
    SELECT series, round(theta, 6) + 0 AS theta, count(t) AS n, {_share("t >= theta")} AS p FROM b JOIN e USING (series) GROUP BY series, theta"""
)
def contiguous_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nulls.contiguous_p_values(masked_returns(spark, sf_dir)).select("series", "n", *S.rounded(theta=F.col("theta"), p=F.col("p")))


@query(
    f"""WITH {BARS_SQL}, {MASK_SQL}, {RET_SQL}, {PLACED_SQL}, c AS (SELECT series, d, m, CASE WHEN m = lag(m) OVER {O} THEN 0 ELSE 1 END AS new FROM z), u AS (SELECT series, m, sum(new) OVER {SO_FAR} - 1 AS j FROM c),
    runs AS (SELECT series, j::INTEGER AS j, m, count(*) AS n FROM u GROUP BY ALL), k AS (SELECT unnest(range({SHUFFLES}))::INTEGER AS k),
    p AS (SELECT series, k, m, n, row_number() OVER (PARTITION BY series, k, m ORDER BY md5(k || ':' || j), n) AS o FROM runs, k), slot AS (SELECT series, j, m, row_number() OVER (PARTITION BY series, m ORDER BY j) AS o FROM runs),
    v AS (SELECT series, k, j, m, p.n FROM p JOIN slot USING (series, m, o)), w AS (SELECT *, sum(n) OVER (PARTITION BY series, k ORDER BY j ROWS UNBOUNDED PRECEDING) - n AS start FROM v),
    n AS (SELECT w.series, k, {THETA.replace("(r,", "(i.r,").replace("(m)", "(w.m)").replace("NOT m", "NOT w.m")} AS t FROM w JOIN i ON i.series = w.series AND i.i BETWEEN w.start AND w.start + w.n - 1 GROUP BY ALL), {REAL_SQL}
    SELECT series, round(theta, 6) + 0 AS theta, count(t) AS n, {_share("t >= theta")} AS p_positive, {_share("t <= theta")} AS p_negative FROM n JOIN e USING (series) WHERE theta IS NOT NULL GROUP BY series, theta"""
)
def episode_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = nulls.episode_p_values(masked_returns(spark, sf_dir), SHUFFLES)
    return p.select("series", "n", *S.rounded(**{c: F.col(c) for c in ("theta", "p_positive", "p_negative")}))


@query(
    f"""WITH {BARS_SQL}, {MASK_SQL}, {RET_SQL}, {PLACED_SQL}, g AS (SELECT series, l, max(i) FILTER (m AND i >= l - 30) AS last, min(i) FILTER (m AND i < 30) AS first FROM i GROUP BY ALL)
    SELECT series, coalesce(l - 1 - last + first + 1 <= 30, false) AS spliced FROM g"""
)
def splice_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nulls.spliced(masked_returns(spark, sf_dir))


@query(
    f"""WITH {BARS_SQL}, {MASK_SQL}, {RET_SQL}, {ROTATED_SQL}, n AS (SELECT series, k, {THETA} AS t FROM rot GROUP BY ALL), e AS (SELECT series, {THETA} AS theta FROM z GROUP BY series),
    p AS (SELECT series AS id, avg((abs(t) >= abs(theta))::INT) AS p FROM n JOIN e USING (series) GROUP BY series), m AS (SELECT greatest(count(*), 3) AS m FROM p), h AS (SELECT m, sum(1.0::DOUBLE / j) AS h FROM (SELECT m, unnest(range(1, m + 1)) AS j FROM m) GROUP BY m),
    o AS (SELECT id, p, row_number() OVER (ORDER BY p, id)::INTEGER AS rank, m, h FROM p, h), l AS (SELECT *, rank / m * 0.5 / h AS lim FROM o)
    SELECT id, round(p, 6) AS p, rank, round(lim, 6) AS "limit", coalesce(rank <= max(CASE WHEN p <= lim THEN rank END) OVER (), false) AS accepted FROM l"""
)
def benjamini_yekutieli(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = nulls.rotation_p_values(masked_returns(spark, sf_dir), DRAWS).select(F.col("series").alias("id"), F.col("p_both").alias("p"))
    return stats.benjamini_yekutieli(p, 0.5).select("id", *S.rounded(p=F.col("p")), "rank", F.round("limit", 6).alias("limit"), "accepted")


@query(
    f"""WITH {BARS_SQL}, {MASK_SQL}, {RET_SQL}, k AS (SELECT series, m, r, row_number() OVER (PARTITION BY series, m ORDER BY r) AS i, count(*) OVER (PARTITION BY series, m) AS n FROM z)
    SELECT series, m, round(avg(r), 6) AS trimmed FROM k WHERE i > floor(n * 0.1::DOUBLE) AND i <= n - floor(n * 0.1::DOUBLE) GROUP BY ALL"""
)
def trimmed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.trimmed_mean(masked_returns(spark, sf_dir), "r", ["series", "m"]).select("series", "m", *S.rounded(trimmed=F.col("trimmed")))


@query(
    f"""WITH {BARS_SQL}, {MASK_SQL}, {RET_SQL}, p AS (SELECT a.series, quantile_cont(a.r - b.r, 0.5) AS x FROM z a JOIN z b ON a.series = b.series AND a.m AND NOT b.m GROUP BY a.series)
    SELECT series, round(any_value(x), 6) AS shift FROM z LEFT JOIN p USING (series) GROUP BY series"""
)
def hodges_lehmann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.hodges_lehmann(masked_returns(spark, sf_dir)).select("series", *S.rounded(shift=F.col("shift")))


QUARTER_SQL = f"k AS (SELECT series, year(d)::VARCHAR || '-Q' || quarter(d) AS quarter, {THETA} AS t FROM z GROUP BY ALL)"


@query(f"WITH {BARS_SQL}, {MASK_SQL}, {RET_SQL}, {QUARTER_SQL} SELECT series, quarter, round(t, 6) + 0 AS theta FROM k")
def theta_by_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_returns(spark, sf_dir).groupBy("series", calendar.quarter(F.col("d")).alias("quarter")).agg(F.round(stats.theta(), 6).alias("theta"))


@query(
    f"""WITH {BARS_SQL}, {MASK_SQL}, {RET_SQL}, {QUARTER_SQL}, c AS (SELECT series, count(t) AS n, count(*) FILTER (t IS NULL) AS undefined, count(*) FILTER (sign(t) = 1) AS same FROM k GROUP BY series)
    SELECT *, CASE WHEN n < 3 OR 2 * same = n THEN 'none' WHEN 2 * same > n THEN 'yes' ELSE 'no' END AS verdict FROM c"""
)
def sign_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarters = masked_returns(spark, sf_dir).groupBy("series", calendar.quarter(F.col("d")).alias("quarter")).agg(stats.theta().alias("t"))
    return stats.sign_consistency(quarters, 1)


@query(
    f"""WITH {MASK_SQL}, c AS (SELECT series, count(*) AS n, count(*) FILTER (m) AS k FROM mask GROUP BY series), x AS (SELECT *, k / n AS p, 1.959963984540054::DOUBLE AS z FROM c)
    SELECT series, k, n, round(greatest((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 0), 6) AS low, round(least((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 1), 6) AS high FROM x"""
)
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stats.mask(metric(spark, sf_dir)).groupBy("series").agg(F.count("*").alias("n"), F.count_if("m").alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return c.select("series", "k", "n", *S.rounded(low=low, high=high))


@query(
    f"""WITH {METRIC_SQL}, a AS (SELECT series, d, value, value - avg(value) OVER (PARTITION BY series) AS c FROM metric), b AS (SELECT *, lag(c) OVER {O} AS b FROM a),
    s AS (SELECT series, least(greatest(coalesce(sum(c * b) / sum(b * b), 0), -0.999), 0.999) AS phi FROM b WHERE b IS NOT NULL GROUP BY series)
    SELECT series, round(phi, 6) AS phi, round(avg(value), 6) AS mean, round(stddev_samp(c - phi * b), 6) AS sd FROM b JOIN s USING (series) GROUP BY series, phi"""
)
def ar1_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ar1(metric(spark, sf_dir)).select("series", *S.rounded(**{c: F.col(c) for c in ("phi", "mean", "sd")}))


@query(
    f"""WITH {BARS_SQL}, {METRIC_SQL}, a AS (SELECT series, d, value FROM metric), x AS (SELECT b.series, b.d, b.close, m.value FROM bars b LEFT JOIN a m USING (series, d))
    SELECT series, count(*) AS n, count(value) AS with_value, round(count(value) / count(*), 6) AS coverage, min(d) FILTER (value IS NULL) AS first_missing FROM x GROUP BY series"""
)
def overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = bars(spark, sf_dir).select("series", "d").join(metric(spark, sf_dir), ["series", "d"], "left")
    return x.groupBy("series").agg(F.count("*").alias("n"), F.count("value").alias("with_value"), F.round(F.count("value") / F.count("*"), 6).alias("coverage"), F.min(F.when(F.col("value").isNull(), F.col("d"))).alias("first_missing"))


_QUARTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


@query("SELECT l_returnflag, count(l_extendedprice) AS n, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 4) AS {k}" for k, q in _QUARTILES.items()) + " FROM lineitem GROUP BY 1")
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of three groups that hold all rows between them."""
    found = quantile.quantiles(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", _QUARTILES)
    return found.select("l_returnflag", "n", *[F.round(k, 4).alias(k) for k in _QUARTILES])
