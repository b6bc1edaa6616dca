"""Queries on the panel's words, notices, alignments and calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import series as S
from tidewell.operators import calendar, context, panel, rolling, stats
from tidewell.plans import context as context_plans
from tidewell.plans import rolling as rolling_plans
from tidewell.plans.rolling import O, _sql_guarded, _w
from tidewell.plans.validation import MASK_SQL, RUNS_SQL
from tidewell.sources.market import AGENDA_DAYS, BARS_SQL, METRIC_SQL, bars, metric, moved_days, moved_days_sql, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _case(x: str, steps: list[tuple[float, str]], rest: str, missing: str | None = None) -> str:
    first = f"WHEN {x} IS NULL THEN {'NULL' if missing is None else repr(missing)}"
    return f"CASE {first} {' '.join(f'WHEN {x} >= {k} THEN {word!r}' for k, word in steps)} ELSE {rest!r} END"


@query(
    f"""WITH {METRIC_SQL}, x AS (SELECT series, d, (rank() OVER (PARTITION BY series ORDER BY value) - 1) * 100 / count(*) OVER (PARTITION BY series) AS p, value * 40 AS ratio, (value - avg(value) OVER (PARTITION BY series)) / nullif(stddev_samp(value) OVER (PARTITION BY series), 0) * 3 AS z FROM metric)
    SELECT series, d, {_case("p", panel.RATIO_PERCENTILES, panel.RATIO_REST, panel.MISSING)} AS by_percentile, {_case("ratio", panel.RATIOS, panel.RATIO_REST, panel.MISSING)} AS by_ratio, {_case("round(z, 6)", panel.Z_SCORES, panel.Z_REST, panel.MISSING)} AS by_z, {_case("p", panel.VALUE_WORDS, panel.VALUE_REST)} AS words FROM x"""
)
def metric_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    v, all_ = F.col("value"), W.partitionBy("series")
    p = (F.rank().over(all_.orderBy("value")) - 1) * 100 / F.count("*").over(all_)
    sd = F.stddev_samp(v).over(all_)
    x = metric(spark, sf_dir).select("series", "d", p.alias("p"), (v * 40).alias("ratio"), F.round((v - F.avg(v).over(all_)) / F.when(sd != 0, sd) * 3, 6).alias("z"))
    return x.select("series", "d", panel.ratio_label(F.col("p")).alias("by_percentile"), panel.fixed_ratio_label(F.col("ratio")).alias("by_ratio"), panel.z_label(F.col("z")).alias("by_z"), panel.value_words(F.col("p")).alias("words"))


@query(
    f"""WITH {METRIC_SQL}, x AS (SELECT series, d, round((value / nullif(lag(value, 60) OVER {O}, 0) - 1) * 100, 6) AS c FROM metric)
    SELECT series, d, CASE WHEN c > 2 THEN 'creciendo' WHEN c > -2 THEN 'estable' WHEN c IS NOT NULL THEN 'cayendo' END AS rate, CASE WHEN c > 5 THEN 'creciendo' WHEN c > -5 THEN 'estable' WHEN c IS NOT NULL THEN 'cayendo' END AS addresses FROM x"""
)
def trend_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = S.before(F.col("value"), 60)
    x = metric(spark, sf_dir).select("series", "d", F.round((F.col("value") / F.when(before != 0, before) - 1) * 100, 6).alias("c"))
    return x.select("series", "d", panel.trend(F.col("c"), 2).alias("rate"), panel.trend(F.col("c"), 5).alias("addresses"))


NOTICES_SQL = f"""notices AS (SELECT series, 'regime' AS source, 'alto' AS level FROM ({context_plans.SQL["regime_detector"]}) WHERE active
UNION ALL SELECT series, 'calibration', CASE WHEN degenerate THEN 'alto' ELSE 'medio' END FROM ({context_plans.SQL["calibration_audit"]}) WHERE degenerate OR unbalanced
UNION ALL SELECT series, 'tails', CASE WHEN p95_total > p95_recent THEN 'medio' ELSE 'alto' END FROM ({context_plans.SQL["tail_comparison"]}) WHERE abs(p95_total - p95_recent) > {panel.TAIL_GAP})"""


@query(f"WITH {NOTICES_SQL} SELECT * FROM notices")
def regime_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = context_plans.QUERIES
    return panel.notices(*[q[name](spark, sf_dir) for name in ("regime_detector", "calibration_audit", "tail_comparison")])


EVENTS_SQL = f"""e(e, kind, weight) AS (VALUES {", ".join(f"(DATE '{d}', 'FOMC', '{'alta' if b else 'media'}')" for d, b in calendar.FOMC)}, {", ".join(f"(DATE '{d}', 'CPI', 'alta')" for d in calendar.CPI)})"""
_DAYS_SQL = f"days AS ({moved_days_sql(AGENDA_DAYS)})"

# each series' last day, moved to where the events are, some days apart
_MOVED = "9165 + 16 * k - CASE WHEN k % 2 = 0 THEN 250 ELSE 0 END"
_SENTENCE_SQL = f"""'Ahora mismo, BTC ' || {_case("coalesce(percentile, 50)", panel.VALUE_WORDS, panel.VALUE_REST)} || ' y ' || CASE coalesce(label, '') {" ".join(f"WHEN '{k}' THEN '{w}'" for k, w in panel.VOL_WORDS.items())} ELSE '{panel.VOL_UNKNOWN}' END
|| CASE WHEN tranche = 'alta' THEN '{panel.DIVERSIFIES_LITTLE}' ELSE '' END || CASE WHEN alarm THEN ' — y {panel.URGENT[0]}' WHEN halving THEN ' — y {panel.URGENT[1]}' WHEN event THEN ' — y {panel.URGENT[2]}' ELSE '' END || '.'"""


@query(
    f"""WITH {NOTICES_SQL}, s AS (SELECT DISTINCT o_orderpriority AS series FROM orders), v AS ({context_plans.SQL["valuation"]}), t AS ({context_plans.SQL["regime_terciles_6y"]}), c AS ({rolling_plans.SQL["rolling_corr_asof"]}), {BARS_SQL}, days AS (SELECT series, z + ({_MOVED})::INTEGER AS today FROM (SELECT series, max(d) AS z, left(series, 1)::INTEGER AS k FROM bars GROUP BY series)), {EVENTS_SQL},
    p AS (SELECT series, coalesce(today - list_max(list_filter([{", ".join(f"DATE '{h}'" for h in calendar.HALVINGS)}], lambda h: h <= today)) BETWEEN {calendar.WINDOW_START} AND {calendar.WINDOW_END}, false) AS halving, EXISTS (SELECT 1 FROM e WHERE e.e - today BETWEEN 0 AND 7) AS event FROM days),
    l AS (SELECT series, arg_max(tranche, d) FILTER (tranche IS NOT NULL) AS tranche FROM c GROUP BY series), a AS (SELECT DISTINCT series, true AS alarm FROM notices WHERE level = 'alto'),
    x AS (SELECT s.series, v.percentile, t.label, l.tranche, coalesce(a.alarm, false) AS alarm, p.halving, p.event FROM s LEFT JOIN p ON p.series = s.series LEFT JOIN v ON v.series = s.series LEFT JOIN t ON t.series = s.series LEFT JOIN l ON l.series = s.series LEFT JOIN a ON a.series = s.series)
    SELECT series, {_SENTENCE_SQL} AS sentence FROM x"""
)
def summary_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sentence a series, on its last day moved to where the events are."""
    q, r = context_plans.QUERIES, rolling_plans.QUERIES
    v = q["valuation"](spark, sf_dir).select("series", "percentile")
    t = q["regime_terciles_6y"](spark, sf_dir).select("series", "label")
    known = F.col("tranche").isNotNull()
    c = r["rolling_corr_asof"](spark, sf_dir).groupBy("series").agg(F.max_by("tranche", F.when(known, F.col("d"))).alias("tranche"))
    alarm = regime_notices(spark, sf_dir).where("level = 'alto'").select("series").distinct().withColumn("alarm", F.lit(True))
    x = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series")).distinct()
    last = bars(spark, sf_dir).groupBy("series").agg(F.max("d").alias("z")).withColumn("k", F.left("series", F.lit(1)).cast("int"))
    days = last.select("series", F.date_add("z", F.expr(_MOVED)).alias("today"))
    coming = calendar.agenda(calendar.events(spark), days, horizon=7).select("series", F.lit(True).alias("event")).distinct()
    phase = calendar.halving_phase(days.select("series", F.col("today").alias("d")))
    for other in (v, t, c, alarm, coming, phase.select("series", "state")):
        x = x.join(other, "series", "left")
    flags = (F.coalesce("alarm", F.lit(False)), F.coalesce(F.col("state") == "en_ventana", F.lit(False)), F.coalesce("event", F.lit(False)))
    return x.select("series", panel.sentence(F.col("percentile"), F.col("label"), F.col("tranche"), *flags).alias("sentence"))


@query(
    f"""WITH r AS ({context_plans.SQL["expected_range"]}), v AS ({context_plans.SQL["valuation"]}), c AS ({context_plans.SQL["cycle"]}), s AS ({context_plans.SQL["situation"]})
    SELECT r.series, round(r.vol * 100, 1) AS vol_30d, round(v.percentile) AS percentile_valuation, round(c.drawdown, 1) + 0 AS drawdown, round(s.vs_sma200, 1) + 0 AS vs_sma200, round(r.vol * sqrt(30.0::DOUBLE / 365) * 100, 4) AS monthly_move
    FROM r JOIN v USING (series) JOIN c USING (series) JOIN s USING (series)"""
)
def journal_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a journal records of the panel when a decision is taken."""
    q = context_plans.QUERIES
    r = q["expected_range"](spark, sf_dir).select("series", "vol")
    x = r.join(q["valuation"](spark, sf_dir).select("series", "percentile"), "series").join(q["cycle"](spark, sf_dir).select("series", "drawdown"), "series").join(q["situation"](spark, sf_dir).select("series", "vs_sma200"), "series")
    return x.select("series", F.round(F.col("vol") * 100, 1).alias("vol_30d"), F.round("percentile").alias("percentile_valuation"), F.round("drawdown", 1).alias("drawdown"), F.round("vs_sma200", 1).alias("vs_sma200"), F.round(panel.monthly_move(F.col("vol")), 4).alias("monthly_move"))


@query(
    f"""WITH {EVENTS_SQL}, {_DAYS_SQL}, n AS (SELECT d, min(e - d)::INTEGER AS days FROM days LEFT JOIN (SELECT * FROM e WHERE weight = 'alta') e ON e - d BETWEEN 0 AND 7 GROUP BY d)
    SELECT d, days, CASE WHEN days <= 2 THEN '{panel.LIGHTS[0]}' WHEN days IS NOT NULL THEN '{panel.LIGHTS[1]}' ELSE '{panel.LIGHTS[2]}' END AS light FROM n"""
)
def noise_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.noise(moved_days(spark, sf_dir, AGENDA_DAYS), calendar.events(spark))


@query(f"WITH {EVENTS_SQL}, {_DAYS_SQL}, l AS (SELECT max(e) AS last FROM e), x AS (SELECT d, CASE WHEN last >= d THEN last END AS until FROM days, l) SELECT d, until, round((until - d) / 30.4::DOUBLE, 6) AS months, coalesce((until - d) / 30.4::DOUBLE >= 3, false) AS ok FROM x")
def calendar_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.sufficiency(moved_days(spark, sf_dir, AGENDA_DAYS), calendar.events(spark))


_NAMES = lambda words: "['" + "', '".join(words) + "']"


@query(f"SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, {_NAMES(panel.DAYS)}[isodow(o_orderdate)] || ' ' || day(o_orderdate) || ' de ' || {_NAMES(panel.MONTHS)}[month(o_orderdate)] || ' de ' || year(o_orderdate) AS spoken FROM orders")
def spoken_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct().select("d", panel.spoken_date(F.col("d")).alias("spoken"))


@query(
    """WITH x AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN ts END AS ts FROM events)
    SELECT event_id, (epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(date_trunc('second', ts))) / 86400000000.0::DOUBLE AS days, coalesce(epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(date_trunc('second', ts)) > 10 * 86400000000, false) AS old FROM x"""
)
def digest_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.when(F.col("event_id") % 9 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("no date")
    days, old = panel.age(made, F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", days.alias("days"), old.alias("old"))


@query(
    f"""WITH {BARS_SQL}, x AS (SELECT series, d, close, {_sql_guarded("avg", "close", 200)} AS sma FROM bars QUALIFY d = max(d) OVER (PARTITION BY series)), r AS (SELECT series, CASE WHEN close > sma THEN round(sma, 3) END AS reference, floor(sma / 500) * 500 AS given FROM x)
    SELECT series, reference, coalesce(abs(given - reference) <= 250, false) AS used FROM r"""
)
def exit_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = context.latest(bars(spark, sf_dir).select("series", "d", "close", S.sma(S.close(), 200).alias("sma200")))
    return panel.exit_reference(last, F.floor(F.col("sma200") / 500) * 500)


ALIGNED_SQL = f"{BARS_SQL}, {METRIC_SQL}, aligned AS (SELECT coalesce(b.series, m.series) AS series, coalesce(b.d, m.d) AS d, close, value AS metric FROM bars b FULL JOIN metric m ON b.series = m.series AND b.d = m.d)"


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.aligned({"close": bars(spark, sf_dir).select("series", "d", F.col("close").alias("value")), "metric": metric(spark, sf_dir)})


@query(f"WITH {ALIGNED_SQL} SELECT series, d, close, round(metric, 6) AS metric FROM aligned")
def outer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir).select("series", "d", "close", *S.rounded(metric=F.col("metric")))


@query(f"""WITH {ALIGNED_SQL}, x AS (SELECT year(d) AS epoch, unnest(['close', 'metric']) AS "column", unnest([close IS NOT NULL, metric IS NOT NULL]) AS has FROM aligned) SELECT epoch, "column", count(*) AS days, count(*) FILTER (has) AS present, round(count(*) FILTER (has) / count(*), 6) AS share FROM x GROUP BY ALL""")
def coverage_by_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.coverage(_aligned(spark, sf_dir), ["close", "metric"], F.year("d"))


@query(f"WITH {BARS_SQL}, {METRIC_SQL}, j AS (SELECT m.series, m.d, b.d AS priced FROM metric m LEFT JOIN bars b ON b.series = m.series AND b.d = m.d) SELECT series, count(priced) AS common, count(*) FILTER (priced IS NULL) AS without_price, min(d) FILTER (priced IS NULL) AS first_without_price FROM j GROUP BY series")
def price_denominator_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.common_days(bars(spark, sf_dir), metric(spark, sf_dir))


@query(
    f"""WITH {METRIC_SQL}, v AS (SELECT series, d, CASE WHEN dayofyear(d) % 50 = 0 AND series < '3' THEN value + 1 ELSE value END AS value FROM metric WHERE NOT (dayofyear(d) % 90 = 0 AND series < '2')),
    j AS (SELECT m.series, m.d, m.value, v.value AS now, v.d AS there FROM metric m LEFT JOIN v ON v.series = m.series AND v.d = m.d),
    g AS (SELECT series, count(there) AS common, count(*) FILTER (there IS NULL) AS missing, min(d) FILTER (there IS NULL) AS first_missing, count(*) FILTER (there IS NOT NULL AND value IS DISTINCT FROM now) AS different, min(d) FILTER (there IS NOT NULL AND value IS DISTINCT FROM now) AS first_different FROM j GROUP BY series)
    SELECT *, missing = 0 AND different = 0 AS identical FROM g"""
)
def overlap_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric against a later snapshot of it that was revised for some series."""
    old = metric(spark, sf_dir)
    day = F.dayofyear("d")
    new = old.where(~((day % 90 == 0) & (F.col("series") < "2"))).withColumn("value", F.when((day % 50 == 0) & (F.col("series") < "3"), F.col("value") + 1).otherwise(F.col("value")))
    return panel.overlap_diff(old, new)


@query(f"""WITH {BARS_SQL}, {RUNS_SQL}, g AS (SELECT series, count(*) AS gaps, max(n) AS longest FROM runs GROUP BY series), x AS (SELECT series, coalesce(gaps, 0) AS gaps, coalesce(longest, 0) AS longest FROM (SELECT DISTINCT series FROM bars) LEFT JOIN g USING (series))
    SELECT *, CASE WHEN longest = 0 THEN 'nothing' WHEN longest <= 2 THEN 'fill' ELSE 'abort' END AS action FROM x""")
def gap_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.gap_policy(bars(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {BARS_SQL}, {RUNS_SQL}, k AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY a)::INTEGER AS k, a, z FROM runs), p AS (SELECT series, k, a - CASE WHEN k % 5 = 0 THEN 40 ELSE 0 END AS a, z - CASE WHEN k % 7 = 0 THEN 5 ELSE 0 END AS z FROM k),
    q AS (SELECT *, CASE WHEN z < a THEN 'reversed' WHEN isodow(a) > 5 OR isodow(z) > 5 THEN 'weekend' END AS own FROM p),
    c(series, k, a, z, problem, last) AS (
      SELECT series, k, a, z, own, CASE WHEN own IS NULL THEN z END FROM q WHERE k = 1
      UNION ALL SELECT q.series, q.k, q.a, q.z, coalesce(q.own, CASE WHEN q.a <= c.last THEN 'out of order' END), CASE WHEN q.own IS NULL AND (c.last IS NULL OR q.a > c.last) THEN q.z ELSE c.last END FROM c JOIN q ON q.series = c.series AND q.k = c.k + 1)
    SELECT series, k, a, z, problem FROM c"""
)
def declared_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps as declared by a careless hand: some reversed, some out of order."""
    from pyspark.sql import Window as W

    b = bars(spark, sf_dir)
    k = calendar.runs(calendar.missing(calendar.days(b), b)).withColumn("k", F.row_number().over(W.partitionBy("series").orderBy("a")))
    shift = lambda c, n, days: F.date_sub(c, F.when(F.col("k") % n == 0, days).otherwise(0))
    return panel.declared_gap_problems(k.select("series", "k", shift("a", 5, 40).alias("a"), shift("z", 7, 5).alias("z")))


@query(f"""WITH {MASK_SQL}, {RUNS_SQL.replace("bars", "metric")}, bad AS (SELECT DISTINCT b.series, b.d FROM metric b JOIN runs r ON b.series = r.series AND n >= 3 AND b.d BETWEEN a AND z + 20) SELECT series, d, m FROM mask ANTI JOIN bad USING (series, d)""")
def mask_without_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked days that no long gap of the metric makes unusable."""
    m = metric(spark, sf_dir)
    return stats.mask(m).select("series", "d", "m").join(calendar.nulled_days(m), ["series", "d"], "left_anti")


@query(
    f"""WITH {METRIC_SQL} SELECT series, d, round(CASE WHEN count(value) OVER {_w(365)} = 365 THEN quantile_cont(value, 0.8) OVER {_w(365)} END, 6) AS q80, round({_sql_guarded("stddev_pop", "value", 30)}, 6) AS sd30, (lead(d, 30) OVER {O} - d)::INTEGER AS span30 FROM metric"""
)
def row_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantile of 365 rows, standard deviation of 30 (divided by their number), days that 30 rows span."""
    v = F.col("value")
    m = rolling.quantiles_of_rows(metric(spark, sf_dir), "value", {"q80": 0.8}, 365)
    return m.select("series", "d", *S.rounded(q80=F.col("q80"), sd30=S.population_sd(v, 30)), S.span_of_rows(30).alias("span30"))


@query(f"WITH {METRIC_SQL}, x AS (SELECT series, max(lead) AS longest FROM (SELECT series, lead(d, 30) OVER {O} - d AS lead FROM metric) GROUP BY series), n AS (SELECT series, count(*) AS n FROM metric GROUP BY series) SELECT series, n, round(n / 30, 6) AS effective, longest::INTEGER AS longest FROM n JOIN x USING (series)")
def effective_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days over the horizon of 30, and the most days that 30 observations span."""
    x = metric(spark, sf_dir).select("series", "d", S.span_of_rows(30).alias("s"))
    return x.groupBy("series").agg(F.count("*").alias("n"), F.round(F.count("*") / 30, 6).alias("effective"), F.max("s").alias("longest"))


@query(f"WITH {ALIGNED_SQL} SELECT series, d, round(first_value(metric IGNORE NULLS) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS back, round(last_value(metric IGNORE NULLS) OVER (PARTITION BY series ORDER BY d ROWS UNBOUNDED PRECEDING), 6) AS forward FROM aligned")
def fill_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("metric")
    return _aligned(spark, sf_dir).select("series", "d", *S.rounded(back=S.filled_back(m), forward=S.filled(m)))


@query("SELECT source, doc_id FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 12")
def feed_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 12 items of each feed (the report's own limit)."""
    return panel.first_of_each(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("source", "doc_id"), "source", "doc_id", 12)
