"""URL filters: host-suffix and path-prefix expressions joined to rules on short hash prefixes.

Every distinct url is expanded into expressions "host suffix + path prefix" (only of the shapes that some rule has: so many
labels, so many characters). Expressions meet the rules in an equi-join on the first 8 hex digits of their SHA-256, then the
whole digest confirms the hit and the longest rule decides. All of it is DataFrame functions.

Defined cases: a null url or one without "://" has an empty host and path and fits no rule; of two rules with the same
expression the blocking one wins; a rule with a null or empty host is ignored, a null path counts as empty; repeated rows each
get their verdict; an empty table gives an empty result; other columns of the pages are kept out of the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict): a rule fits its host and all subdomains when the url's path starts with the rule's.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: The verdict where no rule fits.
DEFAULT = "allow"
PREFIX_DIGITS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """rules: host, path, verdict -> a row for each expression."""
    path = F.coalesce("path", F.lit(""))
    host = F.translate("host", UPPER, LOWER)
    return (
        rules.where(F.length("host") > 0)
        .select(host.alias("r_host"), path.alias("r_path"), F.col("verdict").alias("r_verdict"))
        .groupBy("r_host", "r_path")
        .agg(F.max("r_verdict").alias("r_verdict"))  # block > allow
        .withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path")))
        .withColumn("r_short", F.substring("r_digest", 1, PREFIX_DIGITS))
        .withColumn("rule", F.concat("r_host", "r_path"))
    )


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """pages with host, path, rule and verdict for each row.

    The shapes of the rules (numbers of labels, lengths of paths) are gathered at the driver: integers under the length of a
    url, however many rules there are.
    """
    known = prepare_rules(rules)
    shapes = known.agg(
        F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels"), F.collect_set(F.length("r_path")).alias("lengths")
    ).first()
    labels = F.array(*[F.lit(x) for x in sorted(shapes["labels"])]).cast("array<int>")
    lengths = F.array(*[F.lit(x) for x in sorted(shapes["lengths"])]).cast("array<int>")
    clash = {c: f"_in_{i}" for i, c in enumerate(pages.columns)}
    kept = pages.select([F.col(f"`{c}`").alias(n) for c, n in clash.items()]).withColumn("u_url", F.col(clash[url]))
    urls = kept.select("u_url").distinct().select("u_url", host_of(F.col("u_url")).alias("host"), path_of(F.col("u_url")).alias("path"))
    n_labels = F.size(F.split("host", r"\."))
    hosts = F.transform(F.filter(labels, lambda k: k <= n_labels), lambda k: F.array_join(F.slice(F.split("host", r"\."), -k, k), "."))
    paths = F.transform(F.filter(lengths, lambda k: k <= F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))
    hits = (
        urls.select("u_url", F.explode(hosts).alias("e_host"), paths.alias("e_paths"))
        .select("u_url", "e_host", F.explode("e_paths").alias("e_path"))
        .withColumn("e_digest", _digest(F.col("e_host"), F.col("e_path")))
        .withColumn("e_short", F.substring("e_digest", 1, PREFIX_DIGITS))
        .join(known, F.col("e_short") == F.col("r_short"))
        .where(F.col("e_digest") == F.col("r_digest"))
        .groupBy("u_url")
        .agg(F.max(F.struct(F.length("rule").alias("n"), F.length("r_host").alias("m"), "rule", "r_verdict")).alias("best"))
        .select(F.xxhash64("u_url").alias("b_hash"), F.col("u_url").alias("b_url"), "best")
    )
    # The hash as a second key makes both sides be dealt for the join, so that a hot url can be split.
    judged = kept.join(hits, (F.xxhash64("u_url") == F.col("b_hash")) & (F.col("u_url") == F.col("b_url")), "left")
    return judged.select(
        *[F.col(n).alias(c) for c, n in clash.items() if c not in ("host", "path", "rule", "verdict")],
        host_of(F.col("u_url")).alias("host"),
        path_of(F.col("u_url")).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"),
    )


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op10_url_filter": op10_url_filter}
SQL = {
    "op10_url_filter": r"""
WITH p AS (
  SELECT row_number() OVER () AS k, page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
hit AS (
  SELECT k, rh || rp AS rule, v, row_number() OVER (PARTITION BY k ORDER BY length(rh || rp) DESC) AS n
  FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM hit WHERE n = 1) h USING (k)
"""
}
