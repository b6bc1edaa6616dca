"""Queries on point-in-time bands for the range of the next rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.operators import bands as B
from tidewell.plans.rolling import O, _sql_guarded
from tidewell.sources.market import BARS_SQL, bars

QUERIES, SQL = {}, {}
#: First day with bands, and periods that they are judged in.
START = "1995-06-01"
PERIODS = [("1995-96", "1995-06-01", "1996-12-31"), ("1997", "1997-01-01", "1997-12-31"), ("1998-", "1998-01-01", "2001-12-31")]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


AHEAD_SQL = "(PARTITION BY series ORDER BY d ROWS BETWEEN CURRENT ROW AND 30 FOLLOWING)"
BANDS_SQL = f"""{BARS_SQL}, lr AS (SELECT *, ln(close / lag(close) OVER {O}) AS x, row_number() OVER {O} AS t FROM bars),
kr AS (SELECT series, d, t, {_sql_guarded("stddev_samp", "x", 30)} * sqrt(365) AS vol, CASE WHEN count(*) OVER {AHEAD_SQL} = 31 THEN max(close) OVER {AHEAD_SQL} / min(close) OVER {AHEAD_SQL} - 1 END AS amp,
  1 - min(close) OVER {AHEAD_SQL} / close AS fall FROM lr),
k AS (SELECT *, ln(1 + amp) / (vol * sqrt(30 / 365)) AS r FROM kr WHERE vol > 0 AND amp IS NOT NULL),
e AS (SELECT * FROM k WHERE d >= DATE '{START}'),
j AS (SELECT e.series, e.t, e.vol AS now, o.t AS o, o.vol AS v, o.amp AS a, o.r AS r, pow(0.5, (e.t - o.t) / 1095) AS w FROM e JOIN k o ON o.series = e.series AND o.t <= e.t - 30),
cuts AS (SELECT series, t, now, quantile_cont(v, 0.25) AS c1, quantile_cont(v, 0.5) AS c2, quantile_cont(v, 0.75) AS c3, quantile_cont(r, 0.75) AS r75, quantile_cont(r, 0.95) AS r95 FROM j GROUP BY ALL),
ba AS (SELECT j.series, j.t, quantile_cont(a, 0.75) AS a75, quantile_cont(a, 0.95) AS a95 FROM j JOIN cuts c ON c.series = j.series AND c.t = j.t
  WHERE (v >= c1)::INT + (v >= c2)::INT + (v >= c3)::INT = (c.now >= c1)::INT + (c.now >= c2)::INT + (c.now >= c3)::INT GROUP BY ALL),
cw AS (SELECT series, t, r, sum(w) OVER (PARTITION BY series, t ORDER BY r, o ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY series, t) AS cw FROM j),
ce AS (SELECT series, t, max(cw) FILTER (cw < 0.75) AS l75, arg_max(r, cw) FILTER (cw < 0.75) AS a75, min(cw) FILTER (cw >= 0.75) AS h75, arg_min(r, cw) FILTER (cw >= 0.75) AS z75,
  max(cw) FILTER (cw < 0.95) AS l95, arg_max(r, cw) FILTER (cw < 0.95) AS a95, min(cw) FILTER (cw >= 0.95) AS h95, arg_min(r, cw) FILTER (cw >= 0.95) AS z95 FROM cw GROUP BY ALL),
bc AS (SELECT series, t, coalesce(a75 + (z75 - a75) * (0.75 - l75) / (h75 - l75), z75) AS r75, coalesce(a95 + (z95 - a95) * (0.95 - l95) / (h95 - l95), z95) AS r95 FROM ce),
bands AS (SELECT e.series, e.d, e.amp, e.fall, ba.a75, ba.a95, exp(c.r75 * e.vol * sqrt(30 / 365)) - 1 AS b75, exp(c.r95 * e.vol * sqrt(30 / 365)) - 1 AS b95,
  exp(bc.r75 * e.vol * sqrt(30 / 365)) - 1 AS c75, exp(bc.r95 * e.vol * sqrt(30 / 365)) - 1 AS c95
  FROM e LEFT JOIN cuts c ON c.series = e.series AND c.t = e.t LEFT JOIN ba ON ba.series = e.series AND ba.t = e.t LEFT JOIN bc ON bc.series = e.series AND bc.t = e.t)"""


@query(f"WITH {BANDS_SQL} SELECT series, d, " + ", ".join(f"round({c}, 5) AS {c}" for c in ("amp", "fall", "a75", "a95", "b75", "b95", "c75", "c95")) + " FROM bands")
def band_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.bands(B.known_ranges(bars(spark, sf_dir)), START)
    return found.selectExpr("series", "d", *[f"round({c}, 5) AS {c}" for c in ("amp", "fall", "a75", "a95", "b75", "b95", "c75", "c95")])


@query(
    f"""WITH {BANDS_SQL}, p(period, a, z) AS (VALUES {", ".join(f"('{n}', DATE '{a}', DATE '{z}')" for n, a, z in PERIODS)}),
    m AS (SELECT series, d, amp, fall, 'a' AS model, a75 AS q75, a95 AS q95 FROM bands UNION ALL SELECT series, d, amp, fall, 'b', b75, b95 FROM bands UNION ALL SELECT series, d, amp, fall, 'c', c75, c95 FROM bands)
    SELECT series, period, model, count(*) AS n, round(avg((amp <= q75)::INT), 6) AS cover75, round(avg((amp <= q95)::INT), 6) AS cover95, round(avg(q75), 5) AS width75, round(avg(q95), 5) AS width95,
      round(avg(CASE WHEN amp <= q75 THEN 0.25 * (q75 - amp) ELSE 0.75 * (amp - q75) END) + avg(CASE WHEN amp <= q95 THEN 0.05 * (q95 - amp) ELSE 0.95 * (amp - q95) END), 5) AS loss,
      round(avg((fall <= q95 / 2)::INT), 6) AS cover_fall FROM m JOIN p ON d BETWEEN p.a AND p.z WHERE q75 IS NOT NULL GROUP BY ALL"""
)
def band_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the bands held, how wide they were and what they missed, by model and period."""
    x = B.judged(B.bands(B.known_ranges(bars(spark, sf_dir)), START), PERIODS)
    return x.selectExpr("series", "period", "model", "n", "round(cover75, 6) AS cover75", "round(cover95, 6) AS cover95", *[f"round({c}, 5) AS {c}" for c in ("width75", "width95", "loss")], "round(cover_fall, 6) AS cover_fall")
