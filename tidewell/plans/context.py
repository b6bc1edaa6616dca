"""Queries of the context panel on the last bar of each series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.operators import context
from tidewell.plans.rolling import O, RET_SQL, _sql_guarded, _w
from tidewell.sources.market import BARS_SQL, bars

QUERIES, SQL = {}, {}
CAPITAL, LOSS = 10_000.0, 500.0


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


LAST = "QUALIFY d = max(d) OVER (PARTITION BY series)"


def _vol(k: int) -> str:
    return f"v AS (SELECT series, d, close, {_sql_guarded('stddev_samp', 'lret', k)} * sqrt(365) AS v FROM r)"


@query(
    f"""WITH {BARS_SQL}, {RET_SQL},
    x AS (SELECT series, d, close, {_sql_guarded("stddev_samp", "ret", 90)} * sqrt(365) * 100 AS vol, {", ".join(f"{_sql_guarded('avg', 'close', k)} AS sma{k}" for k in (50, 200, 1000))},
      CASE WHEN count(*) OVER {_w(365)} = 365 THEN min(close) OVER {_w(365)} END AS min_365d, CASE WHEN count(*) OVER {_w(365)} = 365 THEN max(close) OVER {_w(365)} END AS max_365d FROM r),
    e AS (SELECT series, max(d) AS last, arg_max(vol, d) AS now, max(close) AS ath FROM x GROUP BY series),
    p AS (SELECT series, CASE WHEN count(*) >= 100 THEN avg((vol < now)::INT) * 100 END AS vol_percentile FROM x JOIN e USING (series) WHERE vol IS NOT NULL AND d >= last - 1826 GROUP BY series),
    a AS (SELECT series, min(d) AS ath_date FROM x JOIN e USING (series) WHERE close = ath GROUP BY series)
    SELECT series, d, close AS price, {", ".join(f"round(sma{k}, 3) AS sma{k}, round((close / sma{k} - 1) * 100, 6) AS vs_sma{k}" for k in (50, 200, 1000))},
      round((close - min_365d) / (max_365d - min_365d) * 100, 6) AS position_365d, round(vol, 6) AS vol, round(vol_percentile, 6) AS vol_percentile, round((close / ath - 1) * 100, 6) AS from_ath, min_365d, max_365d, ath, ath_date
    FROM x JOIN e USING (series) LEFT JOIN p USING (series) JOIN a USING (series) WHERE d = last"""
)
def situation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.situation(bars(spark, sf_dir))


@query(
    f"""WITH {BARS_SQL}, s AS (SELECT series, d, close / {_sql_guarded("avg", "close", 200)} AS m FROM bars),
    e AS (SELECT series, max(d) AS d, arg_max(m, d) AS now FROM s WHERE m IS NOT NULL GROUP BY series),
    p AS (SELECT series, e.d, now, avg((m < now)::INT) * 100 AS p FROM s JOIN e USING (series) WHERE m IS NOT NULL GROUP BY ALL)
    SELECT series, d, round(now, 6) AS mayer, round(p, 6) AS percentile,
      CASE {" ".join(f"WHEN p >= {k} THEN '{label}'" for k, label in context.VALUATION)} ELSE '{context.VALUATION_REST}' END AS label FROM p"""
)
def valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.valuation(bars(spark, sf_dir))


@query(
    f"""WITH {BARS_SQL}, x AS (SELECT series, d, close, close / max(close) OVER (PARTITION BY series ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS dd,
      {", ".join(f"close / lag(close, {k}) OVER {O} - 1 AS r{k}" for k in (30, 90, 365))} FROM bars),
    a AS (SELECT series, min(d) AS h FROM bars WHERE (series, close) IN (SELECT series, max(close) FROM bars GROUP BY series) GROUP BY series)
    SELECT series, d, round(dd * 100, 6) + 0 AS drawdown, {", ".join(f"round(r{k} * 100, 6) + 0 AS ret_{k}" for k in (30, 90, 365))}, (d - h)::INTEGER AS days_since_ath FROM x JOIN a USING (series) {LAST}"""
)
def cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.cycle(bars(spark, sf_dir))


@query(
    f"""WITH {BARS_SQL}, e AS (SELECT series, arg_max(close, d) AS c FROM bars GROUP BY series), f(fall) AS (VALUES {", ".join(f"({x})" for x in context.FALLS)})
    SELECT series, fall::INTEGER AS fall, round(c * (1 + fall / 100), 3) AS price, round({CAPITAL} * (1 + fall / 100), 6) AS "left", round({CAPITAL} - {CAPITAL} * (1 + fall / 100), 6) AS loss,
      round(({CAPITAL} / ({CAPITAL} * (1 + fall / 100)) - 1) * 100, 6) AS rise_needed FROM e, f"""
)
def risk_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.risk(bars(spark, sf_dir), CAPITAL)


_RANGES = ", ".join(f"('{q}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE, {n})" for q, a, b, c, d, n in context.VOL_RANGES)
_QUARTILE = "CASE " + " ".join(f"WHEN v < {c} THEN '{n}'" for c, n in zip(context.VOL_CUTS, context.VOL_LABELS, strict=False)) + f" WHEN v IS NOT NULL THEN '{context.VOL_LABELS[-1]}' END"
_RANGE_SQL = f"""{BARS_SQL}, {RET_SQL}, {_vol(30)}, t(quartile, p25, p50, p75, p95, months) AS (VALUES {_RANGES}),
    e AS (SELECT series, d, close, v, {_QUARTILE} AS quartile FROM v {LAST}),
    p AS (SELECT series, avg((v.v < e.v)::INT) * 100 AS vp FROM v JOIN e USING (series) WHERE v.v IS NOT NULL GROUP BY series),
    g AS (SELECT * FROM e JOIN t USING (quartile) JOIN p USING (series))"""


@query(
    f"""WITH {_RANGE_SQL} SELECT series, d, quartile, months, p25, p50, p75, p95, close AS price, round(v, 6) AS vol, round(vp, 6) AS vol_percentile,
    {", ".join(f"round(close / (1 + {k} / 2), 3) AS low_{k}, round(close * (1 + {k} / 2), 3) AS high_{k}" for k in ("p25", "p50", "p75", "p95"))} FROM g"""
)
def expected_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.expected_range(bars(spark, sf_dir))


@query(
    f"""WITH {_RANGE_SQL}, c AS (SELECT series, unnest(['típico', 'prudente', 'adverso']) AS scenario, unnest([p50 / 2, p75 / 2, p95 / 2]) AS f FROM g)
    SELECT series, scenario, round(f * 100, 6) AS fall, round(least({LOSS} / f, {CAPITAL}), 6) AS capital, {LOSS} / f > {CAPITAL} AS above_capital FROM c"""
)
def position_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.position_sizes(context.expected_range(bars(spark, sf_dir)), CAPITAL, LOSS)


@query(
    f"""WITH {BARS_SQL}, {RET_SQL}, {_vol(90)}, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY d DESC) AS back FROM v WHERE v IS NOT NULL),
    b AS (SELECT series, quantile_cont(v, 0.1) FILTER (back > 1) AS lo, quantile_cont(v, 0.9) FILTER (back > 1) AS hi, arg_max(v, d) AS now FROM n GROUP BY series HAVING count(*) >= {context.REFERENCE_ROWS}),
    o AS (SELECT series, lo, hi, now, count(*) FILTER (back <= 60 AND (v < lo OR v > hi)) AS days_outside, avg((v < now)::INT) FILTER (back > 1) * 100 AS p FROM n JOIN b USING (series) GROUP BY ALL)
    SELECT series, coalesce(days_outside >= 60, false) AS active, round(now * 100, 6) AS vol, round(lo * 100, 6) AS low, round(hi * 100, 6) AS high, round(p, 6) AS percentile,
    CASE WHEN now < lo THEN 'por debajo' WHEN now > hi THEN 'por encima' WHEN now IS NOT NULL THEN 'dentro' END AS side, days_outside, CASE WHEN now IS NULL THEN 'insufficient history' END AS reason FROM (SELECT DISTINCT series FROM bars) LEFT JOIN o USING (series)"""
)
def regime_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.regime_change(bars(spark, sf_dir))


@query(
    f"""WITH {BARS_SQL}, {RET_SQL}, {_vol(30)}, n AS (SELECT series, d, v, max(d) OVER (PARTITION BY series) AS last FROM v),
    m AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY d DESC) AS back, {_QUARTILE} AS label FROM n WHERE v IS NOT NULL),
    g AS (SELECT series, count(*) FILTER (d >= last - 720) AS n, {", ".join(f"100 * count(*) FILTER (d >= last - 720 AND label = '{x}') / count(*) FILTER (d >= last - 720) AS share{k}" for k, x in enumerate(context.VOL_LABELS))},
      {", ".join(f"quantile_cont(v, {q}) FILTER (back <= {context.REFERENCE_ROWS}) AS cut{round(q * 100)}" for q in (0.25, 0.5, 0.75))} FROM m GROUP BY series HAVING count(*) FILTER (d >= last - 720) >= 90),
    h AS (SELECT *, greatest(share0, share1, share2, share3) AS most FROM g)
    SELECT series, n, {", ".join(f"round(share{k}, 6) AS share{k}" for k in range(4))}, {", ".join(f"round(cut{q} * 100, 6) AS cut{q}" for q in (25, 50, 75))},
      CASE {" ".join(f"WHEN share{k} = most THEN '{x}'" for k, x in enumerate(context.VOL_LABELS))} END AS dominant, most > 50 AS degenerate, most > 40 AS unbalanced FROM h"""
)
def calibration_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.calibration(bars(spark, sf_dir))


#: The proxy series are far more volatile than a currency; volatilities so near to the last one are compared.
MARGIN = 3.0
_AHEAD = "(PARTITION BY series ORDER BY d ROWS BETWEEN CURRENT ROW AND 30 FOLLOWING)"


@query(
    f"""WITH {BARS_SQL}, {RET_SQL}, {_vol(30)}, x AS (SELECT series, d, v, CASE WHEN count(*) OVER {_AHEAD} = 31 THEN max(close) OVER {_AHEAD} / min(close) OVER {_AHEAD} - 1 END AS r FROM v),
    e AS (SELECT series, max(d) AS last, arg_max(v, d) AS now FROM v GROUP BY series),
    g AS (SELECT series, count(*) AS n_total, count(*) FILTER (d >= last - 1095) AS n_recent, {", ".join(f"quantile_cont(r, {q}) AS p{p}_total, quantile_cont(r, {q}) FILTER (d >= last - 1095) AS p{p}_recent" for q, p in ((0.95, 95), (0.5, 50)))}
      FROM x JOIN e USING (series) WHERE r IS NOT NULL AND v BETWEEN now - {MARGIN} AND now + {MARGIN} GROUP BY series)
    SELECT series, n_total, n_recent, {", ".join(f"round({c} * 100, 6) AS {c}" for c in ("p95_total", "p95_recent", "p50_total", "p50_recent"))} FROM g WHERE n_total >= 60 AND n_recent >= 60"""
)
def tail_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.tails(bars(spark, sf_dir), MARGIN)


@query(
    f"""WITH {BARS_SQL}, {RET_SQL}, {_vol(30)}, e AS (SELECT series, max(d) AS last FROM v GROUP BY series),
    g AS (SELECT series, last, count(*) AS n, quantile_cont(v, 1.0::DOUBLE / 3) AS a, quantile_cont(v, 2.0::DOUBLE / 3) AS b, arg_max(v, v.d) AS now FROM v JOIN e USING (series) WHERE v IS NOT NULL AND d >= last - INTERVAL 6 YEAR GROUP BY ALL HAVING count(*) >= 252)
    SELECT series, last AS d, n, round(now, 6) AS vol, round(a, 6) AS low, round(b, 6) AS high, CASE WHEN now < a THEN 'Bajo' WHEN now < b THEN 'Normal' ELSE 'Elevado' END AS label FROM g"""
)
def regime_terciles_6y(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.terciles(bars(spark, sf_dir))
