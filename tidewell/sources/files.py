"""Readers of series, logs and documents in CSV and JSON. Blank and unreadable numbers become null; nothing is truncated silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.session import stored

# Names under which files carry the columns of bars, the first one found counting.
ALIASES = {
    "d": ["date", "fecha", "timestamp", "time", "open_time"],
    "open": ["open", "apertura"],
    "high": ["high", "maximo", "máximo"],
    "low": ["low", "minimo", "mínimo"],
    "close": ["close", "cierre", "adj close", "adj_close"],
    "vol": ["volume"],
}


def resolve(columns: list[str], aliases: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Wanted name -> the file's column, whatever its case and outer spaces."""
    known = {c.strip().lower(): c for c in reversed(columns)}
    return {name: known[a] for name, options in (aliases or ALIASES).items() for a in options[::-1] if a in known}


def number(c: Column) -> Column:
    """A double; null for what is none, NaN and infinities."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    return spark.read.option("header", True).option("encoding", encoding).csv(path)


def _series(name: str | None) -> Column:
    return (F.col("series").cast("string") if name is None else F.lit(name)).alias("series")


def load_bars(spark: SparkSession, path: str, series: str | None = "default", least: int = 250, keep: str = "first") -> DataFrame:
    """Bars from CSV files: aliases resolved, null closes left out, the first (or last) row of a date kept, by file name and place in the file.

    series: the name of the one that path holds; None where path has a folder series=<name> for each, all with the same headings. However many there
    are, they are one scan. Fails where a needed column is missing or a series has fewer than least days left.
    """
    raw = _csv(spark, path)
    found = resolve(raw.columns)
    for need in ("d", "close"):
        if need not in found:
            raise ValueError(f"no column for {need} among {raw.columns}")
    value = lambda name: number(F.col(f"`{found.get(name, found['close'])}`"))
    rows = raw.select(
        _series(series), F.to_date(F.col(f"`{found['d']}`").try_cast("timestamp")).alias("d"), *[value(n).alias(n) for n in ("open", "high", "low", "close")],
        (number(F.col(f"`{found['vol']}`")) if "vol" in found else F.lit(None).cast("double")).alias("vol"),
        F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id")).alias("_at"),
    )
    rows = rows.where("d IS NOT NULL AND close IS NOT NULL")
    order = F.col("_at") if keep == "first" else F.desc("_at")
    out = rows.withColumn("_i", F.row_number().over(W.partitionBy("series", "d").orderBy(order))).where("_i = 1").drop("_i", "_at")
    short = out.groupBy("series").count().agg(F.count("*").alias("n"), F.min_by(F.struct("series", "count"), "count").alias("s")).first()
    if least and (not short["n"] or short["s"]["count"] < least):
        raise ValueError(f"{short['s']['count'] if short['n'] else 0} days{' of ' + short['s']['series'] if short['n'] else ''}; {least} are needed")
    return out


def load_metric(spark: SparkSession, path: str, series: str | None = "default", last: str | None = None, encoding: str = "UTF-8", anchors: DataFrame | None = None) -> DataFrame:
    """series, d, value: a date and the first other column. series: as for load_bars(). Fails where a row is dated after last.

    anchors: series, sha256 of each series' one file (where path holds them all). Before a row is read, the raw bytes must have these digests: a file
    that has another, is absent, or isn't expected fails the reader. Files must not be replaced between the two.
    """
    if anchors is not None:
        bad = anchor_verdicts(file_hashes(spark, path), anchors, "series").where("verdict <> 'same'").limit(5).collect()
        if bad:
            raise ValueError("anchors of inputs: " + ", ".join(f"{r['series']} {r['verdict']}" for r in bad))
    raw = _csv(spark, path, encoding)
    day = resolve(raw.columns).get("d", raw.columns[0])
    other = next(c for c in raw.columns if c != day and not (series is None and c == "series"))
    out = raw.select(_series(series), F.to_date(F.col(f"`{day}`").try_cast("timestamp")).alias("d"), number(F.col(f"`{other}`")).alias("value")).where("d IS NOT NULL")
    if last is not None and out.where(F.col("d") > F.to_date(F.lit(last))).limit(1).count():
        raise ValueError(f"{path} has rows after {last}")
    return out


# Columns of a decision journal.
JOURNAL = {"date": "date", "kind": "string", "amount": "double", "limit_price": "double", "vs_sma200": "double", "mood": "string", "result": "string", "reviewed": "boolean"}


def empty_journal(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{c} {kind}" for c, kind in JOURNAL.items()))


def load_journal(spark: SparkSession, path: str) -> DataFrame:
    """A journal from CSV in order of its dates; columns that the file lacks are null, others are left out."""
    raw = _csv(spark, path)
    have = {c.strip().lower(): c for c in raw.columns}
    return raw.select(*[(F.col(f"`{have[c]}`") if c in have else F.lit(None)).try_cast(kind).alias(c) for c, kind in JOURNAL.items()]).orderBy("date")


def load_document(spark: SparkSession, path: str) -> DataFrame:
    """path, doc (variant; null where it isn't JSON) of files with one JSON document each, and the columns that folders <name>=<value> give."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("doc"), *[c for c in raw.columns if c != "value"])


def at_path(doc: Column, path: str, kind: str = "string", default=None) -> Column:
    """What stands at a dotted path of a document, or default."""
    return F.coalesce(F.try_variant_get(doc, "$." + path, kind), F.lit(default))


def leaves(docs: DataFrame, key: str, doc: str) -> DataFrame:
    """key, path, value of all leaves of documents nested to any depth: a step of Spark's own variant_explode for each level, until none is left.

    A null leaf has a null value; empty objects and arrays have no leaves.
    """
    tvf = docs.sparkSession.tvf
    level, out = stored(docs.select(F.col(key), F.lit("$").alias("path"), F.col(doc).alias("v")).where("v IS NOT NULL")), None
    nested = F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")
    while True:
        flat = level.where(~nested).select(key, "path", F.col("v").cast("string").alias("value"))
        out = flat if out is None else out.unionByName(flat)
        if not level.where(nested).limit(1).count():
            return out
        down = level.where(nested).alias("up").lateralJoin(tvf.variant_explode(F.col("up.v").outer()).alias("x"))
        step = F.when(F.col("x.key").isNotNull(), F.concat(F.lit("."), F.col("x.key"))).otherwise(F.concat(F.lit("["), F.col("x.pos").cast("string"), F.lit("]")))
        level = stored(down.select(F.col(f"up.{key}"), F.concat(F.col("up.path"), step).alias("path"), F.col("x.value").alias("v")).where("v IS NOT NULL"))


def fused_cases(frames: list[DataFrame]) -> DataFrame:
    """scenario, level, and the fields of each case (array detail) of several result files, put together."""
    out = None
    for df in frames:
        one = df.select("scenario", "level", F.explode("detail").alias("x")).select("scenario", "level", "x.*")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def load_wide(spark: SparkSession, path: str) -> DataFrame:
    """series, d, value of a CSV with a date and one column for each series."""
    raw = _csv(spark, path)
    day = resolve(raw.columns).get("d", raw.columns[0])
    pairs = F.array(*[F.struct(F.lit(c.strip()).alias("series"), number(F.col(f"`{c}`")).alias("value")) for c in raw.columns if c != day])
    return raw.select(F.to_date(F.col(f"`{day}`").try_cast("timestamp")).alias("d"), F.explode(pairs).alias("p")).select("p.series", "d", "p.value").where("d IS NOT NULL")


def latest_records(spark: SparkSession, folder: str, schema: str, by: str = "log", text: str = "analisis", order: tuple[str, ...] = ("generado",)) -> DataFrame:
    """by and schema's columns: for each log (a folder <by>=<name> with JSON arrays of records) the latest record whose text isn't blank, in one scan.

    Broken files give nothing, and a log without such a record has no row. Nulls of order come before all values.
    """
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(folder)
    rows = raw.where(F.length(F.trim(text)) > 0).select(F.col(by).cast("string").alias(by), F.struct(*[c for c in raw.columns if c != by]).alias("_record"))
    last = rows.groupBy(by).agg(F.max_by("_record", F.struct(*[F.col(f"_record.{c}") for c in order])).alias("_record"))
    return last.select(by, "_record.*")


def latest_record(spark: SparkSession, path: str, text: str = "analisis", order: str = "generado") -> DataFrame:
    """The latest record of a JSON array whose text isn't blank: none or one row."""
    raw = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    if text not in raw.columns or order not in raw.columns:
        return raw.limit(0)
    return raw.where(F.length(F.trim(text)) > 0).orderBy(F.desc(order)).limit(1)


def load_token_histories(spark: SparkSession, folder: str, last: str | None = None) -> DataFrame:
    """id, d, value of a folder with one JSON array of {date, totalCirculatingUSD: {peggedUSD}} for each id, as <id>.json or in a folder id=<id>. Fails on a repeated day."""
    raw = spark.read.option("multiLine", True).schema("date long, totalCirculatingUSD struct<peggedUSD: double>").json(folder)
    name = F.col("id").cast("string") if "id" in raw.columns else F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    out = raw.select(name.alias("id"), F.to_date(F.timestamp_seconds("date")).alias("d"), F.col("totalCirculatingUSD.peggedUSD").alias("value")).where("value IS NOT NULL")
    if last is not None:
        out = out.where(F.col("d") <= F.to_date(F.lit(last)))
    if out.groupBy("id", "d").count().where("count > 1").limit(1).count():
        raise ValueError("a token has two values on one day")
    return out


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of files, read on the executors (a file's bytes are one value), and the columns that folders <name>=<value> give."""
    raw = spark.read.format("binaryFile").load(path)
    named = [c for c in raw.columns if c not in ("path", "modificationTime", "length", "content")]
    return raw.select("path", "length", F.sha2("content", 256).alias("sha256"), *named)


def anchor_verdicts(hashes: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """key, sha256 (the expected one), verdict: same, changed, absent, or unexpected. A key with several files is changed."""
    have = hashes.groupBy(F.col(key).cast("string").alias(key)).agg(F.count("*").alias("_files"), F.min("sha256").alias("_sha"))
    j = expected.select(F.col(key).cast("string").alias(key), "sha256", F.lit(True).alias("_known")).join(have, key, "full")
    same = (F.col("_files") == 1) & F.col("sha256").eqNullSafe(F.col("_sha"))
    verdict = F.when(F.col("_known").isNull(), "unexpected").when(F.col("_files").isNull(), "absent").when(same, "same").otherwise("changed")
    return j.select(key, "sha256", verdict.alias("verdict"))
