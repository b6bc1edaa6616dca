"""Queries on registries, journals and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import journal, registry, text
from tidewell.sources.market import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


ENTRIES_SQL = "entries AS (SELECT o_orderkey AS n, o_custkey AS id, o_orderstatus AS state, year(o_orderdate)::VARCHAR || '-Q' || quarter(o_orderdate) AS lot, o_orderpriority AS field, o_custkey % 97 AS chain FROM orders)"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("n"), F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("state"),
        F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string")).alias("lot"), F.col("o_orderpriority").alias("field"), (F.col("o_custkey") % 97).alias("chain"),
    )


RESOLVED_SQL = f"""{ENTRIES_SQL}, resolved AS (SELECT id, count(*) AS entries, min(n) AS first_n, max(n) AS last_n, arg_min(lot, n) AS lot, arg_max(state, n) AS state, arg_max(state, n) FILTER (state <> 'P') AS plain_state FROM entries GROUP BY id)"""


@query(f"WITH {RESOLVED_SQL} SELECT * FROM resolved")
def registry_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.resolve(entries(spark, sf_dir))


@query(f"""WITH {RESOLVED_SQL} SELECT lot, count(*) AS ids, count(*) FILTER (state = 'F') AS final, 50 - count(*) AS "left", count(*) > 50 AS over FROM resolved GROUP BY lot""")
def registry_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.budget(registry.resolve(entries(spark, sf_dir)), 50)


@query(f"WITH {ENTRIES_SQL} SELECT sha256(lot || '/' || state || '/' || field) AS digest, count(DISTINCT id) AS ids, min(id) AS first_id, max(id) AS last_id FROM entries GROUP BY 1 HAVING count(DISTINCT id) > 1")
def hash_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.collisions(entries(spark, sf_dir), F.sha2(F.concat_ws("/", "lot", "state", "field"), 256))


CHAIN_SQL = f"""{ENTRIES_SQL}, b AS (SELECT chain, n, id || '/' || state || '/' || lot AS body, row_number() OVER (PARTITION BY chain ORDER BY n) AS i FROM entries),
c(chain, i, n, body, previous_hash, hash) AS (
  SELECT chain, i, n, body, '{registry.GENESIS}', sha256('{registry.GENESIS}' || '|' || body) FROM b WHERE i = 1
  UNION ALL SELECT b.chain, b.i, b.n, b.body, c.hash, sha256(c.hash || '|' || b.body) FROM c JOIN b ON b.chain = c.chain AND b.i = c.i + 1)"""


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat_ws("/", F.col("id").cast("string"), "state", "lot")
    return registry.chained(entries(spark, sf_dir).select("chain", "n", body.alias("body")))


@query(f"WITH RECURSIVE {CHAIN_SQL} SELECT chain, n, body, previous_hash, hash FROM c")
def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark, sf_dir)


@query(f"WITH RECURSIVE {CHAIN_SQL}, d AS (SELECT chain, n, i % 50 <> 0 AS good, lag(i % 50 <> 0, 1, true) OVER (PARTITION BY chain ORDER BY n) AS g FROM c) SELECT chain, n, true AS linked, good AS own FROM d WHERE NOT good")
def hash_chain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th body of a chain is changed behind its hash's back."""
    from pyspark.sql import Window as W

    i = F.row_number().over(W.partitionBy("chain").orderBy("n"))
    forged = _chain(spark, sf_dir).withColumn("i", i).withColumn("body", F.when(F.col("i") % 50 == 0, F.lit("forged")).otherwise(F.col("body")))
    return registry.broken_links(forged)


@query(f"WITH {ENTRIES_SQL}, c AS (SELECT chain, count(*) AS entries, count(*) FILTER (n % 1000 <> 7) AS kept FROM entries GROUP BY chain) SELECT *, entries = kept AS extends FROM c")
def chain_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = entries(spark, sf_dir).select("chain", "n", F.sha2(F.col("n").cast("string"), 256).alias("hash"))
    return registry.extends(old, old.where(F.col("n") % 1000 != 7))


@query(
    """WITH x AS (SELECT CAST(ts AS DATE) AS d, CASE WHEN user_id % 11 = 0 THEN NULL ELSE user_id % 40 END AS grp, value, event_id FROM events)
    SELECT d, grp, value, event_id FROM x QUALIFY grp IS NULL OR row_number() OVER (PARTITION BY d, grp ORDER BY value DESC, event_id) = 1"""
)
def group_winner_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.group_winners(_tokens(spark, sf_dir), "grp", "value", "event_id")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select(F.to_date("ts").alias("d"), F.when(user % 11 != 0, user % 40).alias("grp"), "value", "event_id")


@query(
    """WITH x AS (SELECT CAST(ts AS DATE) AS d, CASE WHEN user_id % 11 = 0 THEN NULL ELSE user_id % 40 END AS grp, value, event_id FROM events),
    w AS (SELECT * FROM x QUALIFY grp IS NULL OR row_number() OVER (PARTITION BY d, grp ORDER BY value DESC, event_id) = 1)
    SELECT d, round(sum(value), 4) AS total, count(*) AS n, round(100 * sum(CASE WHEN grp IS NULL THEN value ELSE 0 END) / sum(value), 4) AS unaccredited FROM w WHERE value >= 20 GROUP BY d HAVING count(*) >= 2"""
)
def denominator_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = registry.group_winners(_tokens(spark, sf_dir), "grp", "value", "event_id")
    got = registry.denominators(kept, 20.0, F.col("grp").isNotNull())
    return got.select("d", F.round("total", 4).alias("total"), "n", F.round("unaccredited", 4).alias("unaccredited"))


_STAGES = ["P", "O", "F"]


@query(
    """WITH c AS (SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus IN ('P', 'O', 'F')) AS "reached_P", count(*) FILTER (o_orderstatus IN ('O', 'F')) AS "reached_O", count(*) FILTER (o_orderstatus = 'F') AS "reached_F" FROM orders GROUP BY 1)
    SELECT *, round("reached_O" / nullif("reached_P", 0), 6) AS "P_to_O", round("reached_F" / nullif("reached_O", 0), 6) AS "O_to_F" FROM c"""
)
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), "o_orderstatus")
    return registry.funnel(rows, "priority", "o_orderstatus", _STAGES)


@query("WITH x AS (SELECT o_custkey AS key, o_orderkey AS n, o_orderstatus AS state, o_orderkey % 2 AS v FROM orders), a AS (SELECT key, v, arg_max(state, n) AS state FROM x GROUP BY key, v) SELECT key, arg_max(state, v) AS state FROM a GROUP BY key")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("n"), F.col("o_orderstatus").alias("state"))
    part = lambda v: x.where(F.col("n") % 2 == v).groupBy("key").agg(F.max_by("state", "n").alias("state"))
    return registry.latest_wins(part(0), part(1), "key")


_KINDS = [*journal.ENTER, *journal.LEAVE, journal.NOTHING]
_MOODS = [*journal.RISKY, "Tranquilo", "Con plan", "Cansado"]
JOURNAL_SQL = f"""journal AS (SELECT user_id % 20 AS book, event_id AS n, CAST(ts AS DATE) AS d, {_KINDS}[event_id % 5 + 1] AS kind, value AS amount, CASE WHEN event_id % 4 <> 0 THEN value * 2 END AS limit_price,
  value - 50 AS vs_sma200, CASE WHEN event_id % 7 < 6 THEN {_MOODS}[event_id % 7 + 1] END AS mood, ['ganada', 'perdida', NULL][event_id % 3 + 1] AS result FROM events)"""


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).alias("book"), e.alias("n"), F.to_date("ts").alias("d"), pick(_KINDS, e % 5).alias("kind"), F.col("value").alias("amount"),
        F.when(e % 4 != 0, F.col("value") * 2).alias("limit_price"), (F.col("value") - 50).alias("vs_sma200"),
        F.when(e % 7 < 6, pick([*_MOODS, None], e % 7)).alias("mood"), pick(["ganada", "perdida", None], e % 3).alias("result"),
    )


_IN = "('" + "', '".join(journal.ENTER) + "')"
_OUT = "('" + "', '".join(journal.LEAVE) + "')"
_RISK = "('" + "', '".join(journal.RISKY) + "')"


@query(
    f"""WITH {JOURNAL_SQL} SELECT book, n, d, limit_price FROM journal a WHERE kind IN {_IN} AND limit_price > 150
    AND NOT EXISTS (SELECT 1 FROM journal b WHERE b.book = a.book AND b.d > a.d AND b.kind IN {_OUT})"""
)
def journal_unkept_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.unkept_limits(_journal(spark, sf_dir), 150.0)


@query(
    f"""WITH {JOURNAL_SQL}, d AS (SELECT book, d, arg_max(result, n) FILTER (result IS NOT NULL) AS own FROM journal GROUP BY ALL),
    p AS (SELECT book, d, last_value(own IGNORE NULLS) OVER (PARTITION BY book ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM d),
    enough AS (SELECT book FROM journal GROUP BY book HAVING count(*) FILTER (kind IN {_IN} AND amount IS NOT NULL) >= 4 AND count(result) >= 3),
    e AS (SELECT book, d, amount, row_number() OVER (PARTITION BY book ORDER BY d, n) AS i FROM journal WHERE book IN (SELECT book FROM enough) AND kind IN {_IN} AND amount IS NOT NULL),
    x AS (SELECT book, amount, previous LIKE 'g%' AS won FROM e JOIN p USING (book, d) WHERE i > 1 AND previous IS NOT NULL),
    g AS (SELECT book, count(*) FILTER (won) AS n_won, count(*) FILTER (NOT won) AS n_lost, avg(amount) FILTER (won) AS a, avg(amount) FILTER (NOT won) AS b FROM x GROUP BY book)
    SELECT book, n_won, n_lost, round(a, 5) AS after_won, round(b, 5) AS after_lost, coalesce(n_won >= 2 AND n_lost >= 2 AND a > b * 1.3, false) AS flagged FROM g"""
)
def journal_size_after_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = journal.size_after_result(_journal(spark, sf_dir))
    return got.withColumns({c: F.round(c, 5) for c in ("after_won", "after_lost")})


@query(
    f"""WITH {JOURNAL_SQL}, o AS (SELECT *, kind <> '{journal.NOTHING}' AS act, kind IN {_IN} AS entry, mood IN {_RISK} AS risky, result LIKE 'g%' AS won FROM journal),
    a AS (SELECT *, sum(act::INT) OVER (PARTITION BY book ORDER BY d, n ROWS UNBOUNDED PRECEDING) AS a, sum(act::INT) OVER (PARTITION BY book) AS actives FROM o),
    h AS (SELECT *, act AND a <= actives // 2 AS h1, act AND a > actives // 2 AS h2 FROM a),
    g AS (SELECT book, count(*) AS n, count(*) FILTER (entry) AS entries, count(*) FILTER (entry AND limit_price IS NULL) / nullif(count(*) FILTER (entry), 0) AS without_limit,
      count(*) FILTER (entry AND vs_sma200 > 20) / nullif(count(*) FILTER (entry AND vs_sma200 IS NOT NULL), 0) AS chased, count(*) FILTER (risky) / nullif(count(mood), 0) AS in_risk,
      avg(won::INT) FILTER (result IS NOT NULL AND risky) AS won_in_risk, avg(won::INT) FILTER (result IS NOT NULL AND NOT risky) AS won_calm,
      count(*) FILTER (h1) / greatest(max(d) FILTER (h1) - min(d) FILTER (h1), 1) * 30 AS rate1, count(*) FILTER (h2) / greatest(max(d) FILTER (h2) - min(d) FILTER (h2), 1) * 30 AS rate2, count(*) FILTER (act) AS actives,
      count(*) FILTER (entry AND vs_sma200 IS NOT NULL) AS placed, count(mood) AS moods, count(*) FILTER (result IS NOT NULL AND risky) AS rr, count(*) FILTER (result IS NOT NULL AND NOT risky) AS cr FROM h GROUP BY book)
    SELECT book, n, entries, round(without_limit, 6) AS without_limit, round(chased, 6) AS chased, round(in_risk, 6) AS in_risk, round(won_in_risk, 6) AS won_in_risk, round(won_calm, 6) AS won_calm, round(rate1, 6) AS rate1, round(rate2, 6) AS rate2,
      coalesce(entries >= 3 AND without_limit > 0.3, false) AS no_limits, coalesce(placed >= 4 AND chased > 0.5, false) AS chases, coalesce(moods >= 6 AND in_risk > 0.4, false) AS risky_mood,
      coalesce(rr + cr >= 8 AND rr >= 3 AND cr >= 3 AND won_calm - won_in_risk > 0.2, false) AS mood_costs, coalesce(actives >= 8 AND rate2 > rate1 * 1.5, false) AS faster FROM g WHERE n >= 10"""
)
def journal_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.patterns(_journal(spark, sf_dir))


@query(
    f"""WITH {JOURNAL_SQL}, m AS (SELECT book, mood, count(*) AS c, min(n) AS first FROM journal WHERE mood IS NOT NULL GROUP BY ALL), t AS (SELECT book, mood FROM m QUALIFY row_number() OVER (PARTITION BY book ORDER BY c DESC, first) = 1),
    g AS (SELECT book, count(*) AS n, count(*) FILTER (kind <> '{journal.NOTHING}') AS active, count(limit_price) AS with_limit, count(result) AS reviewed, round(100 * avg((result LIKE 'g%')::INT) FILTER (result IS NOT NULL), 6) AS won FROM journal GROUP BY book)
    SELECT g.*, mood FROM g LEFT JOIN t USING (book)"""
)
def journal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.statistics(_journal(spark, sf_dir))


@query("SELECT page_id, trim(substring(regexp_replace(html, '<[^>]+>', '', 'g'), 1, 280), ' ') AS summary FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.stripped(F.col("html")).alias("summary"))


_STOP = "['" + "', '".join(text.STOP) + "']"
_TITLE = "split_part(text, chr(10), 1)"
WORDS_SQL = f"""words AS (SELECT doc_id, source, {_TITLE} AS title, coalesce(list_sort(list_distinct(list_transform(list_filter(string_split_regex(regexp_replace(lower({_TITLE}), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda w: length(w) > 3 AND NOT list_contains({_STOP}, w)), lambda w: substring(w, 1, 6)))), []) AS words FROM documents)"""


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.substring_index("text", "\n", 1)
    return table(spark, sf_dir, "documents").select("doc_id", "source", title.alias("title"))


@query(f"WITH {WORDS_SQL} SELECT doc_id, array_to_string(words, ' ') AS words FROM words")
def title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir).select("doc_id", F.concat_ws(" ", text.title_words(F.col("title"))).alias("words"))


@query(rf"""WITH b AS (SELECT conv_id, turn, text, regexp_extract(text, '(?is)(?:please|the first|thank)', 0) AS h FROM conversations)
    SELECT conv_id, turn, CASE WHEN h <> '' THEN trim(substring(text, strpos(text, h) + length(h)), E' \t\n\r') END AS summary, CASE WHEN h <> '' THEN trim(substring(text, 1, strpos(text, h) - 1), E' \t\n\r') ELSE text END AS body FROM b""")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary, body = text.sections(F.col("text"), "(?:please|the first|thank)")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", summary.alias("summary"), body.alias("body"))


@query("SELECT doc_id, contains(lower(coalesce(text, '')), 'license') OR contains(lower(coalesce(text, '')), 'copyright') OR contains(lower(coalesce(text, '')), 'password') AS relevant, CASE WHEN (contains(lower(coalesce(source, '')), 'src1') OR contains(lower(coalesce(source, '')), 'src2')) AND upper(coalesce(lang, '')) IN ('EN', 'DE') THEN 'baja' ELSE 'alta' END AS priority FROM documents")
def priority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.relevant(F.col("text"), ["license", "copyright", "password"]).alias("relevant"), text.priority(F.col("source"), F.col("lang"), ["src1", "src2"], ["EN", "DE"]).alias("priority"))


@query(
    f"""WITH RECURSIVE {WORDS_SQL}, n AS (SELECT doc_id // 200 AS day, doc_id % 3 AS level, doc_id AS pos, title, words, row_number() OVER (PARTITION BY doc_id // 200 ORDER BY doc_id % 3, doc_id) AS i FROM words),
    f(day, i, kept, keep) AS (
      SELECT day, i, [words], true FROM n WHERE i = 1
      UNION ALL SELECT day, i, CASE WHEN twice THEN kept ELSE list_append(kept, words) END, NOT twice FROM (
        SELECT n.day, n.i, f.kept, n.words, len(n.words) > 0 AND len(list_filter(f.kept, lambda k: len(k) > 0 AND 2 * len(list_intersect(k, n.words)) >= len(list_distinct(k || n.words)))) > 0 AS twice
        FROM f JOIN n ON n.day = f.day AND n.i = f.i + 1))
    SELECT day, level, pos, title FROM n JOIN f USING (day, i) WHERE keep"""
)
def headline_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines (whole first lines) of a day (documents dealt to days of at most some hundred) kept in order."""
    title = F.substring_index("text", "\n", 1).alias("title")
    titles = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 200).alias("day"), (F.col("doc_id") % 3).alias("level"), F.col("doc_id").alias("pos"), title)
    return text.headline_dedup(titles, "day")


@query(
    """SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN sha256('{"a":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '"ñ ' || event_type || '"' END || ',"b":{"x":[' || event_id || ',true],"z":' || user_id || '},"props":' || replace(props::VARCHAR, ' ', '') || '}') END AS sha FROM events"""
)
def canonical_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with keys in two orders and odd spaces; every eleventh is broken."""
    k = F.col("event_id")
    a = F.concat(F.lit('"a" : '), F.when(k % 3 == 0, F.lit("null")).otherwise(F.concat(F.lit('"ñ '), "event_type", F.lit('"'))))
    b = F.concat(F.lit('"b":{"z": '), "user_id", F.lit(', "x": [ '), k, F.lit(" , true]}"))
    props = F.concat(F.lit('"props":'), "props")
    body = F.when(k % 2 == 0, F.concat_ws(", ", props, b, a)).otherwise(F.concat_ws(" ,", b, a, props))
    doc = F.concat(F.lit("{"), body, F.when(k % 11 != 0, F.lit(" }")).otherwise(F.lit("")))
    return table(spark, sf_dir, "events").select("event_id", registry.canonical_sha(doc).alias("sha"))
