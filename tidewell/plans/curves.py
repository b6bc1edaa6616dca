"""Queries on curves, weights and resamples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import series as S
from tidewell.operators import bootstrap, curves, draws, rolling, stats
from tidewell.plans.validation import MASK_SQL, RET_SQL, masked_returns
from tidewell.sources.market import BARS_SQL, METRIC_SQL, bars, metric, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


POINTS_SQL = "points AS (SELECT o_orderstatus AS scenario, least(floor(o_totalprice / 50000), 9)::DOUBLE AS x, count(*) FILTER (starts_with(o_orderpriority, '1'))::DOUBLE AS hits, count(*)::DOUBLE AS weight FROM orders GROUP BY ALL)"


def _logistic_sql(by: str, points: str) -> str:
    """Recursive terms fit(by, i, a, b) of the same steps."""
    keys = ", ".join(f"r.{c}" for c in by.split(", "))
    return f"""fit({by}, i, a, b) AS (SELECT DISTINCT {by}, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM {points}
  UNION ALL SELECT {by}, i + 1, a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1), b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) FROM (
    SELECT {by}, i, a, b, sum(v) + {curves.RIDGE} AS h0, sum(v * x) AS h1, sum(v * x * x) + {curves.RIDGE} AS h2, sum(g) - {curves.RIDGE} * a AS g0, sum(g * x) - {curves.RIDGE} * b AS g1 FROM (
      SELECT {keys}, r.i, r.a, r.b, p.x, p.weight * (1 / (1 + exp(-least(greatest(r.a + r.b * p.x, -35), 35)))) * (1 - 1 / (1 + exp(-least(greatest(r.a + r.b * p.x, -35), 35)))) AS v, p.hits - p.weight / (1 + exp(-least(greatest(r.a + r.b * p.x, -35), 35))) AS g
      FROM fit r JOIN {points} p USING ({by}) WHERE r.i < {curves.ROUNDS}) GROUP BY {by}, i, a, b))"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.least(F.floor(F.col("o_totalprice") / 50_000), F.lit(9)).cast("double")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("scenario"), step.alias("x")).agg(F.count_if(F.col("o_orderpriority").startswith("1")).cast("double").alias("hits"), F.count("*").cast("double").alias("weight"))


@query(f"WITH RECURSIVE {POINTS_SQL}, {_logistic_sql('scenario', 'points')} SELECT scenario, round(a, 5) AS intercept, round(b, 5) AS slope FROM fit WHERE i = {curves.ROUNDS}")
def curve_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic curves of the share of urgent orders over steps of price, for each status."""
    return curves.logistic(_points(spark, sf_dir), ["scenario"]).select("scenario", F.round("intercept", 5).alias("intercept"), F.round("slope", 5).alias("slope"))


@query(
    f"""WITH {POINTS_SQL}, c AS (SELECT a.scenario, a.x AS a, b.x AS b, sum(p.hits) / sum(p.weight) AS m FROM points a JOIN points b ON a.scenario = b.scenario AND a.x <= b.x JOIN points p ON p.scenario = a.scenario AND p.x BETWEEN a.x AND b.x GROUP BY ALL),
    n AS (SELECT p.scenario, p.x, c.a, min(c.m) AS low FROM points p JOIN c ON c.scenario = p.scenario AND c.a <= p.x AND c.b >= p.x GROUP BY ALL) SELECT scenario, x, round(max(low), 6) AS "level" FROM n GROUP BY scenario, x"""
)
def isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.isotonic(_points(spark, sf_dir), "scenario").select("scenario", "x", *S.rounded(level=F.col("level")))


# How often each level is taken to occur.
_PREVALENCE = {"1-URGENT": 0.1, "2-HIGH": 0.2, "3-MEDIUM": 0.3, "5-LOW": 0.4}
_WEIGHTS_SQL = f"""prevalence(level, p) AS (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in _PREVALENCE.items())}), generated AS (SELECT o_orderpriority AS level, count(*) AS n_generated, count(*) FILTER (o_orderstatus <> 'P') AS n FROM orders GROUP BY 1),
weights AS (SELECT level, n_generated, n, p / n_generated AS weight FROM generated JOIN prevalence USING (level) WHERE n > 0)"""


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("level"), "o_orderstatus")
    return curves.mixture_weights(orders.groupBy("level").agg(F.count("*").alias("n_generated")), orders.where("o_orderstatus <> 'P'").groupBy("level").agg(F.count("*").alias("n")), _PREVALENCE)


@query(f'WITH {_WEIGHTS_SQL} SELECT level AS "level", n_generated, n, round(weight, 9) AS weight, round(weight * n / sum(weight * n) OVER (), 6) AS composition FROM weights')
def mixture_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir).select("level", "n_generated", "n", F.round("weight", 9).alias("weight"), F.round("composition", 6).alias("composition"))


_DRAWS, _GRID = 2000, [0.0, 3.0, 6.0, 9.0]
_PICK = lambda draw, item, n: f"('0x' || substr(md5({draw} || ':' || {item}), 1, 7))::BIGINT % {n}"


@query(
    f"""WITH RECURSIVE {_WEIGHTS_SQL}, cases AS (SELECT o_orderpriority AS level, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n, least(floor(o_totalprice / 50000), 9)::DOUBLE AS x, o_orderstatus = 'F' AS y FROM orders WHERE o_orderstatus <> 'P'),
    c AS (SELECT c.*, w.weight FROM cases c JOIN weights w USING (level)), d AS (SELECT unnest(range({_DRAWS}))::INTEGER AS draw), k AS (SELECT draw, level, {_PICK("draw", "i", "n")} AS i FROM c, d),
    points AS (SELECT draw, x, coalesce(sum(weight) FILTER (y), 0) AS hits, sum(weight) AS weight FROM k JOIN c USING (level, i) GROUP BY ALL), {_logistic_sql("draw", "points")},
    g AS (SELECT draw, unnest({_GRID}::DOUBLE[]) AS x, a, b FROM fit WHERE i = {curves.ROUNDS}), p AS (SELECT draw, x, 1 / (1 + exp(-least(greatest(a + b * x, -35), 35))) AS p FROM g)
    SELECT x, count(*) AS draws, {", ".join(f"round(quantile_cont(p, {q}), 5) AS p{n}" for q, n in ((0.025, "025"), (0.5, "500"), (0.975, "975")))} FROM p GROUP BY x"""
)
def bootstrap_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted logistic curve at a few places, over resamples within each level."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").withColumn("level", F.col("o_orderpriority"))
    cell = F.least(F.floor(F.col("o_totalprice") / 50_000), F.lit(9)).cast("int") * 2 + (F.col("o_orderstatus") == "F").cast("int")
    placed = rolling.numbered(orders.select("level", "o_orderkey", cell.alias("cell")), "level", "o_orderkey", F.floor(F.col("o_orderkey") / 65_536))
    weights = F.broadcast(_weights(spark, sf_dir).select("level", "n", "weight"))
    counts = draws.stratified_counts(placed.join(weights, "level").select("level", F.col("_place").alias("i"), "n", "cell"), _DRAWS)
    amount, x = F.col("count") * F.col("weight"), F.floor(F.col("cell") / 2).cast("double")
    points = counts.join(weights, "level").groupBy("draw", x.alias("x")).agg(F.sum(F.when(F.col("cell") % 2 == 1, amount).otherwise(0.0)).alias("hits"), F.sum(amount).alias("weight"))
    fits = curves.logistic(points, ["draw"]).withColumn("x", F.explode(F.array(*map(F.lit, _GRID))))
    p = fits.select("x", curves.predicted(F.col("intercept"), F.col("slope"), F.col("x")).alias("p"))
    return p.groupBy("x").agg(F.count("*").alias("draws"), *[F.round(F.percentile("p", F.lit(q)), 5).alias(f"p{n}") for q, n in ((0.025, "025"), (0.5, "500"), (0.975, "975"))])


_BOOT = 2000


@query(
    f"""WITH {METRIC_SQL}, v AS (SELECT series, value::DOUBLE AS v, row_number() OVER (PARTITION BY series ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM metric WHERE value IS NOT NULL), s AS (SELECT DISTINCT series, n FROM v), k AS (SELECT unnest(range({_BOOT}))::INTEGER AS k),
    b AS (SELECT series, n, k, j, {_PICK("k", "j", "n")} AS start FROM (SELECT series, n, k, unnest(range(ceil(n / 90)::BIGINT)) AS j FROM s, k)), p AS (SELECT series, n, k, (start + o) % n AS i FROM (SELECT *, unnest(range(90)) AS o FROM b) WHERE j * 90 + o < n),
    q AS (SELECT p.series, k, quantile_cont(v, 0.75) AS q75, quantile_cont(v, 0.95) AS q95 FROM p JOIN v ON v.series = p.series AND v.i = p.i GROUP BY ALL), l AS (SELECT series, k, unnest([0.75, 0.95])::DOUBLE AS share, unnest([q75, q95]) AS q FROM q),
    g AS (SELECT series, share, quantile_cont(q, 0.025) AS low, quantile_cont(q, 0.975) AS high FROM l GROUP BY ALL), r AS (SELECT series, any_value(n) AS n, quantile_cont(v, 0.75) AS q75, quantile_cont(v, 0.95) AS q95 FROM v GROUP BY series)
    SELECT series, share, n, round(CASE WHEN share = 0.75 THEN q75 ELSE q95 END, 6) AS quantile, round(low, 6) AS low, round(high, 6) AS high FROM g JOIN r USING (series)"""
)
def bootstrap_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = curves.block_bootstrap(metric(spark, sf_dir), [0.75, 0.95], _BOOT)
    return got.select("series", "share", "n", *S.rounded(**{c: F.col(c) for c in ("quantile", "low", "high")}))


@query(
    f"""WITH {BARS_SQL}, {MASK_SQL}, {RET_SQL}, w AS (SELECT series, r, 1 + dayofyear(d) % 7 AS w FROM z), c AS (SELECT series, r, sum(w) OVER (PARTITION BY series ORDER BY r, w ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY series) AS c FROM w),
    p AS (SELECT *, lag(r) OVER (PARTITION BY series ORDER BY c, r) AS pr, lag(c) OVER (PARTITION BY series ORDER BY c, r) AS pc FROM c) SELECT series, round(min(CASE WHEN pc IS NULL AND c >= 0.75 THEN r WHEN c >= 0.75 AND pc < 0.75 THEN pr + (r - pr) * (0.75 - pc) / (c - pc) END), 6) AS quantile FROM p GROUP BY series"""
)
def weighted_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = masked_returns(spark, sf_dir).select("series", "r", (1 + F.dayofyear("d") % 7).alias("w"))
    return stats.weighted_quantile(x, "r", "w", 0.75, ["series"]).select("series", *S.rounded(quantile=F.col("quantile")))


@query(
    f"""WITH {BARS_SQL}, {MASK_SQL}, {RET_SQL}, qs AS (SELECT series, m, quantile_cont(r, 0.75) AS q FROM z GROUP BY ALL)
    SELECT series, count(*) AS n, round(avg((r <= q)::INT), 6) AS covered, round(avg(q), 6) + 0 AS width, round(avg(CASE WHEN r <= q THEN 0.25 * (q - r) ELSE 0.75 * (r - q) END), 6) AS loss FROM z JOIN qs USING (series, m) GROUP BY series"""
)
def pinball_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the 75th percentiles of masked and other days cover their returns."""
    z = masked_returns(spark, sf_dir).withColumn("q", F.percentile("r", F.lit(0.75)).over(W.partitionBy("series", "m")))
    return z.groupBy("series").agg(F.count("*").alias("n"), *S.rounded(covered=F.avg((F.col("r") <= F.col("q")).cast("double")), width=F.avg("q"), loss=stats.pinball(F.col("r"), F.col("q"), 0.75)))


#: Placebos of a metric, and the mean length of their blocks.
_PLACEBOS, _LENGTH = 40, 60
_UNIT = "('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296"


@query(
    f"""WITH {BARS_SQL}, {METRIC_SQL}, c AS (SELECT series, d, row_number() OVER (PARTITION BY series ORDER BY d) - 1 AS place, count(*) OVER (PARTITION BY series) AS n, m.value, last_value(m.value IGNORE NULLS) OVER (PARTITION BY series ORDER BY d ROWS UNBOUNDED PRECEDING) AS seen FROM bars LEFT JOIN metric m USING (series, d)),
    p AS (SELECT series, draw, place, n, value IS NOT NULL AS own, place = 0 OR {_UNIT.format("'mark:' || draw || ':' || place")} < 1 / {_LENGTH} AS starts FROM c, range({_PLACEBOS}) t(draw)),
    a AS (SELECT *, max(CASE WHEN starts THEN place END) OVER (PARTITION BY series, draw ORDER BY place ROWS UNBOUNDED PRECEDING) AS begun FROM p),
    s AS (SELECT *, (floor({_UNIT.format("'from:' || draw || ':' || begun")} * n)::BIGINT + place - begun) % n AS source FROM a)
    SELECT s.series, s.draw::INTEGER AS draw, count(*) AS n, count(*) FILTER (s.starts) AS blocks, round(avg(c.seen), 6) AS mean, round(sum(c.seen * s.place) / sum(s.place), 6) AS late FROM s JOIN c ON c.series = s.series AND c.place = s.source WHERE s.own GROUP BY ALL"""
)
def stationary_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placebos of the metric along the bars' days: mean, and the mean weighted by place, of each."""
    x = bootstrap.stationary_placebos(bars(spark, sf_dir), metric(spark, sf_dir), _PLACEBOS, _LENGTH)
    late = F.sum(F.when(F.col("value").isNotNull(), F.col("value") * F.col("place"))) / F.sum("place")
    return x.groupBy("series", "draw").agg(F.count("*").alias("n"), F.count_if("starts").alias("blocks"), F.round(F.avg("value"), 6).alias("mean"), F.round(late, 6).alias("late"))
