"""Rules over a registry's entries (n, id, state, lot, ...): translations, second chances, retirements, novelty, templates, boot checks.

Rules give rows of problems; an empty result means that all holds. Defined cases: nulls in a compared field are equal to each other; ids without entries
of the kind a rule speaks of give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def translated(labels: DataFrame, label: str, mapping: dict[str, str], allowed: list[str]) -> DataFrame:
    """labels with state, the mapped one, and problem: unknown label, or a state outside the closed list (null where there is none)."""
    state = F.lit(None).cast("string")
    for name, to in mapping.items():
        state = F.when(F.col(label) == name, F.lit(to)).otherwise(state)
    problem = F.when(F.col("state").isNull(), "unknown label").when(~F.col("state").isin(*allowed), "state not allowed")
    return labels.withColumn("state", state).withColumn("problem", problem)


def antecedents(entries: DataFrame, resolved: DataFrame, states: list[str]) -> DataFrame:
    """entries: n, id, antecedent; resolved: id, state. n, id, antecedent, problem of entries that name one: unknown, or in none of states."""
    known = resolved.select(F.col("id").alias("antecedent"), F.col("state").alias("_state"), F.lit(True).alias("_known"))
    j = entries.where("antecedent IS NOT NULL").select("n", "id", "antecedent").join(known, "antecedent", "left")
    problem = F.when(F.col("_known").isNull(), "unknown").when(~F.col("_state").isin(*states), "state")
    return j.select("n", "id", "antecedent", problem.alias("problem"))


def template_hash(fields: list[str]) -> Column:
    """SHA-256 over the fields by name as JSON, null where a field is absent: what lacks fields is no template."""
    body = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(fields)]))
    return F.when(F.forall(F.array(*[F.col(c).isNotNull() for c in fields]), lambda x: x), F.sha2(body, 256))


def template_diff(specs: DataFrame, anchors: DataFrame, fields: list[str], by: str) -> DataFrame:
    """specs (by, id, fields) against the anchor of their by: whether the hashes agree (never, where one lacks a field), and the fields that differ, by name."""
    other = anchors.select(F.col(by).alias("_by"), template_hash(fields).alias("_hash"), *[F.col(c).alias(f"_{c}") for c in fields])
    j = specs.withColumn("_own", template_hash(fields)).join(other, F.col(by) == F.col("_by"))
    differ = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in sorted(fields)]))
    return j.select(by, "id", F.coalesce(F.col("_own") == F.col("_hash"), F.lit(False)).alias("same"), F.array_join(differ, ",").alias("differ"))


def second_chances(specs: DataFrame, resolved: DataFrame, eligible: DataFrame, state: str) -> DataFrame:
    """specs: id, lot, antecedent, declaration, same (as the template's anchor). id, problems (letters in order) of specs that name an antecedent.

    a: not among eligible (antecedent); b: not resolved, or not in the state; c: no declaration; d: another id has the antecedent too; e: another
    id of the lot has a second chance too; f: not the template.
    """
    have = specs.where("antecedent IS NOT NULL")
    ok = eligible.select("antecedent", F.lit(True).alias("_ok")).distinct()
    known = resolved.select(F.col("id").alias("antecedent"), F.col("state").alias("_state"))
    j = have.join(ok, "antecedent", "left").join(known, "antecedent", "left")
    shared = lambda c: (F.col(c).isNotNull()) & (F.count("*").over(W.partitionBy(c)) > 1)
    tests = {
        "a": F.col("_ok").isNull(),
        "b": F.coalesce(F.col("_state") != state, F.lit(True)),
        "c": F.length(F.trim(F.coalesce("declaration", F.lit("")))) == 0,
        "d": shared("antecedent"),
        "e": shared("lot"),
        "f": ~F.coalesce("same", F.lit(False)),
    }
    return j.select("id", F.concat(*[F.when(test, F.lit(letter)).otherwise(F.lit("")) for letter, test in tests.items()]).alias("problems"))


def retirements(entries: DataFrame, retired: str, consuming: list[str]) -> DataFrame:
    """entries: n, id, state, successor_of. id, problems of ids that were retired, or that say whom they succeed.

    last: entries follow the retirement; consumed: a state before it counts as consumed; heir: a successor retires in turn;
    not retired: it succeeds an id that isn't.
    """
    at = F.min(F.when(F.col("state") == retired, F.col("n"))).over(W.partitionBy("id"))
    x = entries.select("id", "n", "state", "successor_of", at.alias("at"))
    before = F.col("n") < F.col("at")
    got = x.groupBy("id").agg(
        F.first("at").alias("at"),
        F.max("n").alias("last"),
        F.count_if(before & F.col("state").isin(*consuming)).alias("consumed"),
        F.count_if(before & F.col("successor_of").isNotNull()).alias("heir"),
        F.max_by("successor_of", "n").alias("successor_of"),
    )
    gone = got.where("at IS NOT NULL").select(F.col("id").alias("successor_of"), F.lit(True).alias("_gone"))
    j = got.join(gone, "successor_of", "left").where("at IS NOT NULL OR successor_of IS NOT NULL")
    retired_ = F.col("at").isNotNull()
    names = F.array_compact(
        F.array(
            F.when(retired_ & (F.col("last") > F.col("at")), F.lit("last")),
            F.when(retired_ & (F.col("consumed") > 0), F.lit("consumed")),
            F.when(retired_ & (F.col("heir") > 0), F.lit("heir")),
            F.when(F.col("successor_of").isNotNull() & F.col("_gone").isNull(), F.lit("not retired")),
        )
    )
    return j.select("id", F.array_join(names, ",").alias("problems"))


def novelty(entries: DataFrame) -> DataFrame:
    """entries: lot, id, family. lot, candidates, families, and those that no earlier lot had."""
    got = entries.select("lot", "id", "family", F.min("lot").over(W.partitionBy("family")).alias("_first"))
    new = F.count_distinct(F.when(F.col("lot") == F.col("_first"), F.col("family")))
    return got.groupBy("lot").agg(F.count_distinct("id").alias("candidates"), F.count_distinct("family").alias("families"), new.alias("new_families"))


def compatible(version: Column, supported: str) -> Column:
    """Whether a version's first two numbers are the supported ones."""
    return F.coalesce(F.regexp_extract(version, r"^([^.]*\.[^.]*)", 1) == supported, F.lit(False))


def boot(documents: DataFrame, broken: DataFrame, supported: str, forbidden: str = "maxim") -> DataFrame:
    """documents: id, version, fields (array of names); broken: id of documents with a broken chain. id, verdict: the first gate that closes, or "ok"."""
    bad = broken.select("id").distinct().withColumn("_broken", F.lit(True))
    j = documents.join(bad, "id", "left")
    verdict = F.when(~compatible(F.col("version"), supported), "version").when(F.col("_broken"), "chain").when(F.exists("fields", lambda f: f.contains(forbidden)), "forbidden field").otherwise("ok")
    return j.select("id", verdict.alias("verdict"))


def keys(present: Column, allowed: list[str]) -> list[Column]:
    """Names of an array against a closed list: missing, unknown and common ones, joined in order."""
    closed = F.array(*map(F.lit, sorted(allowed)))
    join = lambda a: F.array_join(F.array_sort(a), ",")
    return [join(F.array_except(closed, present)).alias("missing"), join(F.array_except(present, closed)).alias("unknown"), join(F.array_intersect(closed, present)).alias("common")]


def anchored(hashes: DataFrame, expected: DataFrame) -> DataFrame:
    """hashes: path, sha256; expected: name, sha256. name, verdict of each expected file: same, changed, or absent."""
    have = hashes.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("sha256").alias("_sha"))
    verdict = F.when(F.col("_sha").isNull(), "absent").when(F.col("_sha") == F.col("sha256"), "same").otherwise("changed")
    return expected.join(have, "name", "left").select("name", verdict.alias("verdict"))
