"""Queries on the rules of a registry, on forward confirmation and on the admissibility of masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import confirm, registry, rules, stats, text
from tidewell.plans.records import ENTRIES_SQL, RESOLVED_SQL, entries
from tidewell.plans.rolling import O, SO_FAR, _sql_guarded
from tidewell.plans.validation import AHEAD, MASK_SQL, RET_SQL, THETA, masked_returns
from tidewell.functions import series as S
from tidewell.session import stored
from tidewell.sources.market import BARS_SQL, METRIC_SQL, bars, metric, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


_LABELS = {"O": "EN_TEST", "F": "CONFIRMADA"}


@query(f"""WITH {ENTRIES_SQL}, x AS (SELECT n, CASE state {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LABELS.items())} END AS state FROM entries) SELECT n, state, CASE WHEN state IS NULL THEN 'unknown label' WHEN state <> 'EN_TEST' THEN 'state not allowed' END AS problem FROM x""")
def label_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = entries(spark, sf_dir).select("n", F.col("state").alias("label"))
    return rules.translated(labels, "label", _LABELS, ["EN_TEST"]).select("n", "state", "problem")


_NAMED_SQL = f"{RESOLVED_SQL}, named AS (SELECT n, id, lot, field, state, CASE WHEN n % 13 = 0 THEN id + 7 END AS antecedent, CASE WHEN n % 26 <> 0 THEN 'declared' END AS declaration FROM entries)"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    return entries(spark, sf_dir).withColumns({"antecedent": F.when(n % 13 == 0, F.col("id") + 7), "declaration": F.when(n % 26 != 0, F.lit("declared"))})


@query(f"WITH {_NAMED_SQL} SELECT x.n, x.id, x.antecedent, CASE WHEN r.id IS NULL THEN 'unknown' WHEN r.state NOT IN ('O', 'F') THEN 'state' END AS problem FROM named x LEFT JOIN resolved r ON r.id = x.antecedent WHERE x.antecedent IS NOT NULL")
def antecedent_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _named(spark, sf_dir)
    return rules.antecedents(e, registry.resolve(e), ["O", "F"])


_SHOWN = "coalesce('field=' || field, 'field!') || '|' || coalesce('lot=' || lot, 'lot!')"


@query(
    f"""WITH {ENTRIES_SQL}, a AS (SELECT chain, arg_min(lot, n) AS l, arg_min(field, n) AS f FROM entries GROUP BY chain)
    SELECT chain, n AS id, sha256({_SHOWN}) = sha256('field=' || f || '|lot=' || l) AS same, array_to_string(list_filter([CASE WHEN field IS DISTINCT FROM f THEN 'field' END, CASE WHEN lot IS DISTINCT FROM l THEN 'lot' END], lambda v: v IS NOT NULL), ',') AS differ FROM entries JOIN a USING (chain)"""
)
def template_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry against the first of its chain."""
    e = entries(spark, sf_dir)
    anchors = e.groupBy("chain").agg(F.min_by("lot", "n").alias("lot"), F.min_by("field", "n").alias("field"))
    return rules.template_diff(e.select("chain", F.col("n").alias("id"), "lot", "field"), anchors, ["lot", "field"], "chain")


@query(
    f"""WITH {_NAMED_SQL}, s AS (SELECT *, field = '1-URGENT' AS same FROM named WHERE antecedent IS NOT NULL),
    x AS (SELECT s.n AS id, s.antecedent % 3 <> 0 AS a, coalesce(r.state <> 'F', true) AS b, declaration IS NULL AS c, count(*) OVER (PARTITION BY antecedent) > 1 AS d, count(*) OVER (PARTITION BY s.lot) > 1 AS e, NOT coalesce(same, false) AS f FROM s LEFT JOIN resolved r ON r.id = s.antecedent)
    SELECT id, {" || ".join(f"CASE WHEN {c} THEN '{c}' ELSE '' END" for c in "abcdef")} AS problems FROM x"""
)
def second_chance_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _named(spark, sf_dir)
    eligible = e.where("antecedent % 3 = 0").select("antecedent")
    specs = e.select(F.col("n").alias("id"), "lot", "antecedent", "declaration", (F.col("field") == "1-URGENT").alias("same"))
    return rules.second_chances(specs, registry.resolve(e), eligible, "F")


@query(
    f"""WITH {ENTRIES_SQL}, h AS (SELECT id, n, CASE WHEN n % 17 = 0 THEN 'R' ELSE state END AS state, CASE WHEN n % 19 = 0 THEN id + 1 END AS successor_of FROM entries), x AS (SELECT *, min(n) FILTER (state = 'R') OVER (PARTITION BY id) AS gone_at FROM h),
    g AS (SELECT id, any_value(gone_at) AS gone_at, max(n) AS last, count(*) FILTER (n < gone_at AND state = 'F') AS consumed, count(*) FILTER (n < gone_at AND successor_of IS NOT NULL) AS heir FROM x GROUP BY id),
    l AS (SELECT id, successor_of FROM x QUALIFY n = max(n) OVER (PARTITION BY id)), j AS (SELECT g.id, g.gone_at, g.last, g.consumed, g.heir, l.successor_of, o.id AS gone FROM g JOIN l ON l.id = g.id LEFT JOIN (SELECT id FROM g WHERE gone_at IS NOT NULL) o ON o.id = l.successor_of)
    SELECT id, array_to_string(list_filter([CASE WHEN gone_at IS NOT NULL AND last > gone_at THEN 'last' END, CASE WHEN gone_at IS NOT NULL AND consumed > 0 THEN 'consumed' END, CASE WHEN gone_at IS NOT NULL AND heir > 0 THEN 'heir' END, CASE WHEN successor_of IS NOT NULL AND gone IS NULL THEN 'not retired' END], lambda v: v IS NOT NULL), ',') AS problems
    FROM j WHERE gone_at IS NOT NULL OR successor_of IS NOT NULL"""
)
def retirement_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    h = entries(spark, sf_dir).select("id", "n", F.when(n % 17 == 0, "R").otherwise(F.col("state")).alias("state"), F.when(n % 19 == 0, F.col("id") + 1).alias("successor_of"))
    return rules.retirements(h, "R", ["F"])


@query(f"WITH {ENTRIES_SQL}, e AS (SELECT lot, id, id % 211 AS family FROM entries), f AS (SELECT family, min(lot) AS first FROM e GROUP BY family) SELECT lot, count(DISTINCT id) AS candidates, count(DISTINCT family) AS families, count(DISTINCT family) FILTER (lot = first) AS new_families FROM e JOIN f USING (family) GROUP BY lot")
def lot_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.novelty(entries(spark, sf_dir).select("lot", "id", (F.col("id") % 211).alias("family")))


@query("""WITH x AS (SELECT p_partkey AS id, (2 + (p_partkey % 7 = 0)::INT) || '.' || (p_partkey % 3) || '.1' AS version, p_partkey % 5 = 0 AS broken, p_partkey % 4 = 0 AS forbidden FROM part)
SELECT id, CASE WHEN version NOT LIKE '2.0.%' THEN 'version' WHEN broken THEN 'chain' WHEN forbidden THEN 'forbidden field' ELSE 'ok' END AS verdict FROM x""")
def boot_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    version = F.concat_ws(".", F.when(k % 7 == 0, "3").otherwise("2"), (k % 3).cast("string"), F.lit("1"))
    parts = table(spark, sf_dir, "part").select(k.alias("id"), version.alias("version"), F.array(F.lit("consumidas"), F.when(k % 4 == 0, "maximo").otherwise("reservadas")).alias("fields"))
    return rules.boot(parts, parts.where("id % 5 = 0"), "2.0")


@query("""WITH c AS (SELECT conv_id, list_distinct(list(role) FILTER (role IS NOT NULL)) AS p FROM conversations GROUP BY conv_id), a AS (SELECT *, ['assistant', 'system', 'tool'] AS a FROM c)
SELECT conv_id, array_to_string(list_sort(list_filter(a, lambda v: NOT list_contains(p, v))), ',') AS missing, array_to_string(list_sort(list_filter(p, lambda v: NOT list_contains(a, v))), ',') AS "unknown", array_to_string(list_sort(list_filter(a, lambda v: list_contains(p, v))), ',') AS common FROM a""")
def key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of a conversation against a closed list."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("p"))
    return c.select("conv_id", *rules.keys(F.col("p"), ["system", "assistant", "tool"]))


_NEAR = 0.001


@query(
    f"""WITH {BARS_SQL}, {MASK_SQL}, {RET_SQL}, e AS (SELECT series, max(d) - 455 AS z FROM z GROUP BY series), c AS (SELECT e.series, e.z, {THETA} AS theta FROM e JOIN z ON z.series = e.series AND z.d <= e.z GROUP BY ALL),
    b AS (SELECT series, z, theta, unnest([1, 2, 3, 4, 5]) AS block FROM c WHERE theta IS NOT NULL), k AS (SELECT b.series, block, b.z + 1 + (block - 1) * 91 AS a, b.z + 61 + (block - 1) * 91 AS last FROM b),
    r AS (SELECT k.series, block, m, r FROM z JOIN k ON k.series = z.series AND z.d BETWEEN k.a AND k.last), t AS (SELECT series, block, {THETA} AS t FROM r GROUP BY ALL),
    v AS (SELECT b.series, b.theta, count(t) AS defined, count(*) FILTER (t <> 0 AND sign(t) = sign(theta)) AS same FROM b LEFT JOIN t ON t.series = b.series AND t.block = b.block GROUP BY ALL), w AS (SELECT series, {THETA} AS theta_f, count(*) AS days FROM r GROUP BY series),
    j AS (SELECT v.*, theta_f, coalesce(days, 0) AS days, CASE WHEN defined < 3 OR 2 * same = defined THEN 'none' WHEN 2 * same > defined THEN 'yes' ELSE 'no' END AS verdict FROM v LEFT JOIN w USING (series))
    SELECT series, defined, same, days, verdict, round(theta, 6) + 0 AS theta, round(theta_f, 6) + 0 AS theta_f, CASE WHEN verdict = 'none' THEN 'PENDIENTE_REVISION' WHEN coalesce(verdict = 'yes' AND sign(theta_f) = sign(theta) AND abs(theta_f) >= greatest(abs(theta) / 2, {_NEAR}), false) THEN 'CONFIRMADA' ELSE 'RECHAZADA_FORWARD' END AS outcome FROM j"""
)
def forward_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 455 days confirm (or not) the effect over all days before."""
    z = masked_returns(spark, sf_dir)
    cut = z.groupBy("series").agg(F.date_sub(F.max("d"), 455).alias("z"))
    tested = z.join(cut, "series").where(F.col("d") <= F.col("z")).groupBy("series", "z").agg(stats.theta().alias("theta")).where("theta IS NOT NULL")
    return confirm.forward(z, tested, _NEAR)


_TRIED_SQL = f"""tried AS (SELECT series, max(d) - 455 + CASE WHEN series LIKE '5%' THEN 600 ELSE 0 END AS z FROM z GROUP BY series),
    effects AS (SELECT series, z, CASE WHEN series LIKE '2%' THEN 0 ELSE theta END AS theta FROM (SELECT t.series, t.z, {THETA} AS theta FROM tried t JOIN z ON z.series = t.series AND z.d <= t.z GROUP BY ALL)),
    new_metric AS (SELECT series, d, value + CASE WHEN series LIKE '3%' AND day(d) = 1 THEN 1 ELSE 0 END AS value FROM metric), new_price AS (SELECT series, d, close AS value FROM bars WHERE NOT (series LIKE '4%' AND day(d) = 2)),
    seen AS (SELECT t.series, count(*) FILTER (n.value IS DISTINCT FROM o.value) AS bad, any_value(last) AS last FROM tried t JOIN metric o ON o.series = t.series AND o.d <= t.z LEFT JOIN new_metric n ON n.series = o.series AND n.d = o.d JOIN (SELECT series, max(d) AS last FROM new_metric GROUP BY series) l ON l.series = t.series GROUP BY t.series),
    paid AS (SELECT t.series, count(*) FILTER (n.value IS DISTINCT FROM o.close) AS bad, any_value(last) AS last FROM tried t JOIN bars o ON o.series = t.series AND o.d <= t.z LEFT JOIN new_price n ON n.series = o.series AND n.d = o.d JOIN (SELECT series, max(d) AS last FROM new_price GROUP BY series) l ON l.series = t.series GROUP BY t.series)"""


@query(
    f"""WITH {BARS_SQL}, {MASK_SQL}, {RET_SQL}, {_TRIED_SQL},
    p AS (SELECT e.series, CASE WHEN theta IS NULL THEN 'no theta' WHEN theta = 0 THEN 'theta is 0' WHEN seen.bad > 0 THEN 'metric revised' WHEN paid.bad > 0 THEN 'price revised' WHEN seen.last < z + 425 THEN 'metric ends early' WHEN paid.last < z + 455 THEN 'price ends early' END AS problem
      FROM effects e JOIN seen ON seen.series = e.series JOIN paid ON paid.series = e.series), f AS ({SQL["forward_confirmation"]})
    SELECT p.series, problem, CASE WHEN problem IS NULL THEN outcome END AS outcome, CASE WHEN problem IS NULL THEN theta_f END AS theta_f FROM p LEFT JOIN f ON f.series = p.series"""
)
def checked_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmation of series of which one was revised, one has lost days, one has no effect and one ends too early."""
    z = stored(masked_returns(spark, sf_dir))  # read four times
    is_ = lambda k: F.col("series").startswith(k)
    cut = z.groupBy("series").agg(F.date_add(F.max("d"), -455).alias("z")).withColumn("z", F.when(is_("5"), F.date_add("z", 600)).otherwise(F.col("z")))
    tested = z.join(cut, "series").where(F.col("d") <= F.col("z")).groupBy("series", "z").agg(stats.theta().alias("theta"))
    ends = tested.withColumn("theta", F.when(is_("2"), 0.0).otherwise(F.col("theta")))
    m, p = (stored(x.select("series", "d", F.col(c).alias("value"))) for x, c in ((metric(spark, sf_dir), "value"), (bars(spark, sf_dir), "close")))
    seen = lambda x: x.join(cut, "series").where(F.col("d") <= F.col("z")).select("series", "d", "value")
    revised = m.withColumn("value", F.col("value") + F.when(is_("3") & (F.day("d") == 1), 1).otherwise(0))
    fewer = p.where(~(is_("4") & (F.day("d") == 2)))
    problems = confirm.forward_problems(ends, revised, fewer, seen(m), seen(p))
    return confirm.checked_forward(z, ends, problems, _NEAR).select("series", "problem", "outcome", "theta_f")


@query(
    f"""WITH {BARS_SQL}, {MASK_SQL}, ret AS (SELECT series, d, lead(close, {AHEAD}) OVER {O} / close - 1 AS r FROM bars), x AS (SELECT series, d, m, r FROM mask LEFT JOIN ret USING (series, d)),
    c AS (SELECT series, min(d) + ((max(d) - min(d)) // 2)::INTEGER AS cut FROM x GROUP BY series), h AS (SELECT x.*, d <= cut AS one FROM x JOIN c USING (series)),
    f AS (SELECT series, min(d) AS first, max(d) AS last FROM h WHERE one GROUP BY series), k AS (SELECT series, first, last, unnest([1, 2, 3, 4]) AS segment FROM f),
    s AS (SELECT series, segment, first + round_even((last - first) * (segment - 1) / 4, 0)::INTEGER AS a, first + round_even((last - first) * segment / 4, 0)::INTEGER - CASE WHEN segment = 4 THEN 0 ELSE 1 END AS e FROM k),
    p AS (SELECT h.series, segment, count(*) AS days, count(r) AS n, count(*) FILTER (r IS NOT NULL AND m) AS c FROM h JOIN s ON s.series = h.series AND h.d BETWEEN s.a AND s.e WHERE one GROUP BY ALL),
    b AS (SELECT series, coalesce(string_agg(segment::VARCHAR, ',' ORDER BY segment) FILTER (NOT (n >= 3 AND c > 0 AND c < n)), '') AS flat, coalesce(string_agg(segment::VARCHAR, ',' ORDER BY segment) FILTER (days / 30 < 3), '') AS thin FROM p GROUP BY series),
    g AS (SELECT series, d FROM (SELECT series, d, {_sql_guarded("avg", "close", 200)} AS s FROM bars) WHERE s IS NOT NULL), e AS (SELECT h.series, count(*) / 30 AS effective FROM h JOIN g ON g.series = h.series AND g.d = h.d WHERE one AND r IS NOT NULL GROUP BY h.series),
    w AS (SELECT series, d, CASE WHEN d - lag(d) OVER {O} <= 30 THEN 0 ELSE 1 END AS new FROM h WHERE NOT one AND r IS NOT NULL AND m), q2 AS (SELECT series, count(*) AS masked, sum(new)::BIGINT AS episodes FROM w GROUP BY series),
    u AS (SELECT series, m, CASE WHEN m = lag(m) OVER {O} THEN 0 ELSE 1 END AS new, d FROM x), y AS (SELECT series, m, sum(new) OVER {SO_FAR} AS run FROM u), l AS (SELECT series, avg(n) AS run FROM (SELECT series, run, count(*) AS n FROM y WHERE m GROUP BY ALL) GROUP BY series),
    a AS (SELECT series, count(*) AS n, count(*) FILTER (m) AS active FROM x GROUP BY series)
    SELECT a.series, a.n, active, flat, thin, round(coalesce(l.run, 0), 6) AS run, round(coalesce(effective, 0), 6) AS effective, coalesce(masked, 0) AS masked, coalesce(episodes, 0) AS episodes, flat = '' AND thin = '' AND coalesce(effective, 0) >= 10 AND coalesce(masked, 0) >= 30 AND coalesce(episodes, 0) >= 5 AS admissible
    FROM a LEFT JOIN l ON l.series = a.series LEFT JOIN b ON b.series = a.series LEFT JOIN e ON e.series = a.series LEFT JOIN q2 ON q2.series = a.series"""
)
def structural_admissibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    r = b.select("series", "d", (S.after(S.close(), AHEAD) / S.close() - 1).alias("r"))
    x = stats.mask(metric(spark, sf_dir)).select("series", "d", "m").join(r, ["series", "d"], "left")
    base = b.select("series", "d", S.sma(S.close(), 200).alias("s")).where("s IS NOT NULL")
    return confirm.admissibility(x, base)


@query("""WITH c AS (SELECT o_orderpriority AS "level", count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS k FROM orders GROUP BY 1), x AS (SELECT *, k / n AS p, 1.959963984540054::DOUBLE AS z FROM c)
SELECT "level", n, k, round(p, 6) AS share, round(greatest((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 0), 6) AS low, round(least((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 1), 6) AS high FROM x""")
def survival_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each level's cases the share that ends well, with its interval."""
    c = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("level")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return c.select("level", "n", "k", *S.rounded(share=F.col("k") / F.col("n"), low=low, high=high))


@query(
    """WITH RECURSIVE c AS (SELECT o_orderpriority AS "level", count(*)::INTEGER AS n, count(*) FILTER (o_orderstatus = 'P')::INTEGER AS k FROM orders GROUP BY 1),
    g(level, n, k, i, a, b, e, f) AS (SELECT "level", n, k, 0, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE FROM c
      UNION ALL SELECT level, n, k, i + 1, CASE WHEN up < 0.025 THEN (a + b) / 2 ELSE a END, CASE WHEN up < 0.025 THEN b ELSE (a + b) / 2 END, CASE WHEN down > 0.025 THEN (e + f) / 2 ELSE e END, CASE WHEN down > 0.025 THEN f ELSE (e + f) / 2 END
      FROM (SELECT *, list_sum(list_transform(range(k, n + 1), lambda j: exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln((a + b) / 2) + (n - j) * ln(1 - (a + b) / 2)))) AS up,
        list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln((e + f) / 2) + (n - j) * ln(1 - (e + f) / 2)))) AS down FROM g WHERE i < 45))
    SELECT level AS "level", k, n, CASE WHEN k = 0 THEN 0 ELSE round((a + b) / 2, 6) END AS low, CASE WHEN k = n THEN 1 ELSE round((e + f) / 2, 6) END AS high FROM g WHERE i = 45"""
)
def clopper_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("level")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("k"))
    x = c.withColumn("x", stats.clopper_pearson(F.col("k"), F.col("n")))
    return x.select("level", "k", "n", *S.rounded(low=F.col("x.low"), high=F.col("x.high")))


_QUOTED = "['license', 'copyright', 'password', 'idiot']"


@query(f"SELECT doc_id, array_to_string(list_filter({_QUOTED}, lambda w: contains(coalesce(text, ''), w)), ',') AS mentioned, len(regexp_extract_all(coalesce(text, ''), '[a-z_]+(?:[.][a-z_]+)+'))::INTEGER AS paths FROM documents")
def mentions_and_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a few ids a prose names, and how many dotted paths it holds."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.mentioned(t, ["license", "copyright", "password", "idiot"]).alias("mentioned"), F.size(text.dotted_paths(t)).alias("paths"))
