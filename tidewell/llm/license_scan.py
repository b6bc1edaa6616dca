"""License scans: sentences with known identifiers, then ordered rules over the sequence of identifiers.

A text is normalised: A-Z lower-cased, every run of other characters than letters and digits made one space. A run with ".",
"!" or "?" and white space behind, or with a blank line, is a cut; one with a line end, or with ";" and a space or tab behind, is a
soft cut. What stands between two cuts of either kind is a piece. From each piece on, up to MOST pieces are put together, as
wrapped lines are, but none beyond a cut; such a sentence has its opening ("This file is licensed under the terms of") made "under" and
the SLOT of a named party made one word. It is then looked up by equality in the table of known sentences (SENTENCES): whole, or, for open
sentences, by its first words, in which case the rest of its last piece goes with it. Of several that begin at one piece the one with
the most words is taken; one that begins within a sentence found before it doesn't count.

Known sentences map to identifiers (GPL, GPL_VER, ...); a document's identifiers in order of sentences form a string such as
";MIT_REL;APACHE;" in which the ordered rules are looked up: a rule found consumes its identifiers, so that later rules don't
count them again. All of it is DataFrame functions over one row: no shuffle, and the table of sentences is a constant of the plan.

Defined cases: null and empty texts have no sentences and no licences; a repeated licence counts as often as it stands there;
identifiers that no rule uses are listed as unmatched; an empty table gives an empty result; columns named as results (ids, licenses, unmatched) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The forms of the openings that stand for "under", the names that may follow it, and what they are identified as.
OPENING = r"^(?:this (?:file|work|software|program|library) is )?(?:licensed|released|distributed) under (?:the terms of )?"
OPENING_WORDS = ["this", "licensed", "released", "distributed"]
GNU_VERSIONS = ["1", "1 0", "2", "2 0", "3", "3 0"]
GNU_ENDS = ["", " only", " or later", " or any later version", " or at your option any later version"]
LESSER_VERSIONS = ["2", "2 0", "2 1", "3", "3 0"]
COMMONS = [
    ("CC_BY", ["by", "attribution"]),
    ("CC_BY_SA", ["by sa", "attribution sharealike", "attribution share alike"]),
    ("CC_BY_NC", ["by nc", "attribution noncommercial", "attribution non commercial"]),
    ("CC_BY_ND", ["by nd", "attribution noderivatives", "attribution noderivs", "attribution no derivatives"]),
]
UNDER = [
    ("APACHE", ["the apache license", "the apache license the license", "the apache license version 2 0", "the apache license version 2 0 the license", "apache license version 2 0", "the apache 2 0 license", "apache 2 0"]),
    ("MIT", ["the mit license", "mit license", "the mit license mit"]),
    ("BSD", ["the bsd license", "the new bsd license", "the simplified bsd license", "the 2 clause bsd license", "the 3 clause bsd license", "the bsd 2 clause license", "the bsd 3 clause license"]),
]
# Whole sentences.
CLOSED = [
    ("APACHE_MAY_NOT", "you may not use this file except in compliance with the license"),
    ("RIGHTS", "all rights reserved"),
    ("APACHE", "spdx license identifier apache 2 0"),
    ("MIT", "spdx license identifier mit"),
    ("BSD", "spdx license identifier bsd 2 clause"),
    ("BSD", "spdx license identifier bsd 3 clause"),
    ("GPL_VER", "spdx license identifier gpl 2 0"),
    ("GPL_VER", "spdx license identifier gpl 2 0 only"),
    ("GPL_VER", "spdx license identifier gpl 2 0 or later"),
    ("GPL_VER", "spdx license identifier gpl 3 0"),
    ("GPL_VER", "spdx license identifier gpl 3 0 only"),
    ("GPL_VER", "spdx license identifier gpl 3 0 or later"),
    ("MPL", "spdx license identifier mpl 2 0"),
]
# First words of sentences whose rest doesn't matter.
OPEN = [
    ("APACHE_COPY", "you may obtain a copy of the license at"),
    ("ASIS", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("ASIS", "the software is provided as is"),
    ("ASIS", "this software is provided by somebody as is"),
    ("MIT_PERMISSION", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("MIT_NOTICE", "the above copyright notice and this permission notice shall be included in all copies"),
    ("GPL_FREE", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("GPL_NO_WARRANTY", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("BSD_REDISTRIBUTION", "redistribution and use in source and binary forms with or without modification are permitted provided that"),
    ("MPL", "this source code form is subject to the terms of the mozilla public license"),
]
# Licences in the order in which they are looked for, and the identifiers they need, one behind the other.
LICENSES = [
    ("Apache-2.0-header", ["APACHE", "APACHE_MAY_NOT", "APACHE_COPY", "ASIS"]),
    ("MIT-text", ["MIT_PERMISSION", "MIT_NOTICE", "ASIS"]),
    ("GPL-header", ["GPL_FREE", "GPL_NO_WARRANTY"]),
    ("BSD-text", ["BSD_REDISTRIBUTION", "ASIS"]),
    ("Apache-2.0", ["APACHE"]),
    ("MIT", ["MIT"]),
    ("LGPL", ["LGPL_VER"]),
    ("GPL", ["GPL_VER"]),
    ("BSD", ["BSD"]),
    ("CC-BY-SA", ["CC_BY_SA"]),
    ("CC-BY-NC", ["CC_BY_NC"]),
    ("CC-BY-ND", ["CC_BY_ND"]),
    ("CC-BY", ["CC_BY"]),
    ("MPL", ["MPL"]),
    ("proprietary", ["RIGHTS"]),
]
#: Every known sentence has one of these, however it is wrapped or spaced; most texts end here.
WORDS = r"(?i)license|gpl|apache|permission|redistribution|reserved|provided|warranty|commons|cc[^\p{L}\p{N}]+(by|attribution)"
CUT, SOFT = "#", "|"
#: The named party of a sentence: at most 20 words, which "somebody" stands for.
SLOT, SLOT_WORDS = r"^(this software is provided by)(?: [^ ]+){1,20}? as is(?= |$)", 20


def sentences() -> list[tuple[str, str, bool]]:
    """The table of known sentences: words, identifier, whether more may follow."""
    under = [(x, f"under {name}", False) for x, names in UNDER for name in names]
    gnu = [f"{name} {v}{n}{end}" for name in ("the gnu general public license", "the gnu gpl", "the gpl") for v in ("version ", "v") for n in GNU_VERSIONS for end in GNU_ENDS]
    lesser = [f"the gnu lesser general public license version {n}" for n in LESSER_VERSIONS]
    commons = [(x, f"{a}{by} {kind}") for x, kinds in COMMONS for kind in kinds for by in ("creative commons", "cc") for a in ("", "a ", "the ")]
    under += [("GPL_VER", f"under {name}", False) for name in gnu] + [("LGPL_VER", f"under {name}", True) for name in lesser] + [(x, f"under {name}", True) for x, name in commons]
    known = under + [(x, words, False) for x, words in CLOSED] + [(x, words, True) for x, words in OPEN]
    return [(words, x, more) for x, words, more in known]


SENTENCES = sentences()
FIRST = sorted({*OPENING_WORDS, *(words.split()[0] for words, _, _ in SENTENCES if not words.startswith("under "))})
#: Pieces that a known sentence has at most, one for each word, with its opening or slot written out.
MOST = max(len(words.split()) for words, _, _ in SENTENCES) + SLOT_WORDS


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.transform(F.array(value), f)[0]


def _table(more: bool) -> Column:
    return F.create_map(*[F.lit(v) for words, x, m in SENTENCES if m == more for v in (words, x)])


def normalised(text: Column) -> Column:
    """Words with one space, SOFT or CUT between two; each run of other characters is looked at once, from its start."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + CUT + SOFT, "abcdefghijklmnopqrstuvwxyz--")
    other = r"[^\p{L}\p{N}]"
    cut = F.regexp_replace(low, rf"(?<!{other}){other}*?(?:[.!?]\s|\n{other}*\n){other}*", CUT)
    other = rf"[^\p{{L}}\p{{N}}{CUT}]"
    soft = F.regexp_replace(cut, rf"(?<!{other}){other}*?(?:\n|;[ \t]){other}*", SOFT)
    return F.trim(F.regexp_replace(soft, rf"[^\p{{L}}\p{{N}}{CUT}{SOFT}]+", " "))


def known_from(sentence: Column) -> Column:
    """Of a normalised sentence: the known one it is, or that it begins with, as struct n (words), id; the longest; null if none."""
    closed, opened = _table(False), _table(True)
    lengths = sorted({len(words.split()) for words, _, more in SENTENCES if more})

    def found(s: Column) -> Column:
        n = F.size(F.split(s, " "))
        whole = F.struct(n.alias("n"), F.try_element_at(closed, s).alias("id"))
        heads = [F.struct(F.least(n, F.lit(k)).alias("n"), F.try_element_at(opened, F.substring_index(s, " ", k)).alias("id")) for k in lengths]
        return F.array_max(F.filter(F.array(whole, *heads), lambda x: x["id"].isNotNull()))

    return _let(F.regexp_replace(F.regexp_replace(sentence, OPENING, "under "), SLOT, "$1 somebody as is"), found)


def _hits(pieces: Column) -> Column:
    """Known sentences in the pieces between two cuts, in order: struct at (first piece, from 1), end (the piece behind), id."""
    size = F.size(pieces)

    def longest(at: Column) -> Column:
        def upto(n: Column) -> Column:
            best = known_from(F.concat_ws(" ", F.slice(pieces, at, n)))
            return _let(best, lambda b: F.struct(b["n"].alias("n"), (-n).alias("pieces"), b["id"].alias("id")))

        tried = F.transform(F.sequence(F.lit(1), F.least(size - at + 1, F.lit(MOST))), upto)
        best = F.array_max(F.filter(tried, lambda b: b["id"].isNotNull()))
        return _let(best, lambda b: F.struct(at.alias("at"), (at - b["pieces"]).alias("end"), b["id"].alias("id")))

    starts = F.filter(F.sequence(F.lit(1), size), lambda at: F.substring_index(F.get(pieces, at - 1), " ", 1).isin(FIRST))
    hits = F.filter(F.transform(starts, longest), lambda h: h["id"].isNotNull())
    # a sentence has at most MOST pieces, so only the MOST hits before one can reach into it
    before = lambda all_, p: F.slice(all_, F.greatest(p - MOST + 1, F.lit(1)), F.least(p, F.lit(MOST)))
    return _let(hits, lambda all_: F.filter(all_, lambda h, p: ~F.exists(before(all_, p), lambda b: b["end"] > h["at"])))


def sentence_ids(text: Column) -> Column:
    """Identifiers of a text's known sentences, in order."""
    spans = F.filter(F.split(normalised(text), CUT), lambda s: s.rlike(WORDS))
    pieces = F.transform(spans, lambda s: F.filter(F.transform(F.split(s, r"\|"), lambda p: F.trim(p)), lambda p: p != ""))
    return F.transform(F.flatten(F.transform(pieces, lambda p: F.when(F.size(p) > 0, _hits(p)).otherwise(F.array().cast("array<struct<at:int,end:int,id:string>>")))), lambda h: h["id"])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ids (array), licenses (array of struct name, n) and unmatched (array): see the module."""
    found = docs.withColumn("ids", F.coalesce(F.when(F.col(text).rlike(WORDS), sentence_ids(F.col(text))), F.array().cast("array<string>")))
    # ";A;;B;": each identifier with both bounds of its own, so that a rule's pattern is its identifiers put together
    rest = F.concat_ws("", F.transform("ids", lambda x: F.concat(F.lit(";"), x, F.lit(";"))))
    state = F.struct(rest.alias("rest"), F.array().cast("array<struct<name:string,n:int>>").alias("out"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f";{x};" for x in ids)).alias("key")) for name, ids in LICENSES])

    def step(acc: Column, rule: Column) -> Column:
        left = F.replace(acc["rest"], rule["key"], F.lit("|"))
        n = ((F.length(acc["rest"]) - F.length(left)) / (F.length(rule["key"]) - 1)).cast("int")
        one = F.array(F.struct(rule["name"].alias("name"), n.alias("n")))
        return F.struct(left.alias("rest"), F.when(n > 0, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    done = F.when(F.size("ids") > 0, F.aggregate(rules, state, step)).otherwise(state)
    return (
        found.withColumn("_done", done)
        .withColumn("licenses", F.col("_done.out"))
        .withColumn("unmatched", F.filter(F.split(F.col("_done.rest"), r"[;|]+"), lambda x: x != ""))
        .drop("_done")
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select(
        "doc_id",
        F.size("ids").alias("n_known"),
        F.concat_ws(",", "ids").alias("sentence_ids"),
        F.concat_ws(",", F.transform("licenses", lambda x: F.concat(x["name"], F.lit("*"), x["n"].cast("string")))).alias("licenses"),
        F.concat_ws(",", "unmatched").alias("unmatched"),
    )


QUERIES = {"op1_license_scan": op1_license_scan}


def _sql() -> str:
    rows = ", ".join(f"('{words}', '{x}', {str(more).lower()}, {len(words.split())})" for words, x, more in SENTENCES)
    first = ", ".join(f"'{w}'" for w in FIRST)
    steps, last = [], "s0"
    for k, (name, ids) in enumerate(LICENSES, 1):
        key = "".join(f";{x};" for x in ids)
        steps.append(
            f"s{k} AS (SELECT doc_id, k, ids, replace(rest, '{key}', '|') AS rest, "
            f"CASE WHEN contains(rest, '{key}') THEN list_append(o, '{name}*' || ((length(rest) - length(replace(rest, '{key}', '|'))) // {len(key) - 1})::VARCHAR) ELSE o END AS o FROM {last})"
        )
        last = f"s{k}"
    other = r"[^\p{L}\p{N}]"
    return rf"""
WITH t(words, id, more, n) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents),
a AS (
  SELECT k, regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ#|', 'abcdefghijklmnopqrstuvwxyz--'), '{other}*(?:[.!?][ \t\n\x0B\f\r]|\n{other}*\n){other}*', '#', 'g') AS s
  FROM d WHERE regexp_matches(text, '{WORDS}')),
b AS (SELECT k, unnest(string_split(s, '#')) AS s, unnest(range(len(string_split(s, '#')))) AS u FROM a),
c AS (SELECT k, u, string_split_regex(s, '{other}*(?:\n|;[ \t]){other}*') AS p FROM b),
e AS (SELECT k, u, list_filter(list_transform(p, lambda x: trim(regexp_replace(x, '{other}+', ' ', 'g'), ' ')), lambda x: x <> '') AS p FROM c),
f AS (SELECT k, u, p, unnest(range(1, len(p) + 1)) AS i FROM e),
g AS (SELECT k, u, p, i, unnest(range(i, least(i + {MOST}, len(p) + 1))) AS j FROM f WHERE string_split(p[i], ' ')[1] IN ({first})),
h AS (SELECT k, u, i, j, regexp_replace(regexp_replace(array_to_string(p[i:j], ' '), '{OPENING}', 'under '), '^(this software is provided by)(?: [^ ]+){{1,{SLOT_WORDS}}}? as is($| )', '\1 somebody as is\2') AS s FROM g),
m AS (
  SELECT k, u, i, j, t.id FROM h JOIN t ON CASE WHEN more THEN starts_with(s || ' ', words || ' ') ELSE s = words END
  QUALIFY row_number() OVER (PARTITION BY k, u, i ORDER BY n DESC, j, t.id DESC) = 1),
o AS (SELECT *, max(j) OVER (PARTITION BY k, u ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM m),
g2 AS (SELECT k, list(id ORDER BY u, i) AS ids FROM o WHERE until IS NULL OR until < i GROUP BY k),
s0 AS (SELECT doc_id, k, coalesce(ids, []::VARCHAR[]) AS ids, array_to_string(list_transform(coalesce(ids, []::VARCHAR[]), lambda v: ';' || v || ';'), '') AS rest, []::VARCHAR[] AS o FROM d LEFT JOIN g2 USING (k)),
{", ".join(steps)}
SELECT doc_id, len(ids)::INTEGER AS n_known, array_to_string(ids, ',') AS sentence_ids, array_to_string(o, ',') AS licenses,
       array_to_string(list_filter(string_split_regex(rest, '[;|]+'), lambda v: v <> ''), ',') AS unmatched
FROM {last}
"""


SQL = {"op1_license_scan": _sql()}
