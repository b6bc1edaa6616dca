"""Downloaded feeds and search results as rows: one document that can't be read is an error of its source, not the end of the others.

Documents come as (source, body), read whole from files. Schemas are given, so nothing is inferred from what a source sends.

A feed's length costs in proportion only: `from_xml` copies an array of items for each item that it adds, and what is carried beside an exploded item is
copied with it. So whole documents are only judged (with a schema that keeps one item), and items are read from pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators import text
from tidewell.session import bounded_batches

_TEXT = "struct<_VALUE: string>"
_KEPT = "_corrupt_record string"
_ITEM = f"struct<title: string, description: string, link: string, guid: {_TEXT}, pubDate: string>"
_ENTRY = f"struct<title: {_TEXT}, summary: {_TEXT}, link: array<struct<_href: string>>, published: string, updated: string>"
#: RSS 2.0 and Atom, as far as items are concerned.
RSS = f"channel struct<item: array<{_ITEM}>>, {_KEPT}"
ATOM = f"entry array<{_ENTRY}>, {_KEPT}"
#: The same, each item in the place of the one before: reads as much and fails on the same documents.
RSS_JUDGED = f"channel struct<item: {_ITEM}>, {_KEPT}"
ATOM_JUDGED = f"entry {_ENTRY}, {_KEPT}"
#: Where items stand below the root, and what to put around a piece.
FORMS = {"rss": (("channel", "item"), b"<rss><channel>", b"</channel></rss>"), "atom": (("entry",), b"<feed>", b"</feed>")}
PIECE = 1 << 18
HITS = f"error string, hits struct<hits: array<struct<_id: string, _source: struct<display_names: array<string>, root_forms: array<string>, ciks: array<string>, file_date: string>>>>, {_KEPT}"
SUMMARY = 280


def _first(*values: Column) -> Column:
    """The first that isn't blank, trimmed; else empty."""
    return F.coalesce(*[F.when(F.length(F.trim(v)) > 0, F.trim(v)) for v in values], F.lit(""))


class _Whole(Exception):
    """A document that isn't to be cut."""


def pieces(body: bytes, form: str, size: int = PIECE) -> Iterator[bytes]:
    """A well-formed feed (UTF-8) cut between items into documents of its form, of about size bytes or one item; none if it has no items.

    Prefixes and case of names don't matter and of several channels the last one counts, as in `from_xml`. What expat doesn't read, and what has a DTD,
    comes whole.
    """
    path, before, after = FORMS[form]
    depth = found = end = 0  # found: how many names of the path are open
    starts: list[int] = []

    def start(name: str, _) -> None:
        nonlocal depth, found
        if depth - 1 == found < len(path) and name.rpartition(":")[2].lower() == path[found]:
            found += 1
            if found == len(path):
                starts.append(parser.CurrentByteIndex)
            else:
                starts.clear()
        depth += 1

    def stop(_) -> None:
        nonlocal depth, found, end
        if depth == len(path) and found == depth - 1:
            end = parser.CurrentByteIndex
        if depth - 1 == found > 0:
            found -= 1
        depth -= 1

    def whole(*_) -> None:
        raise _Whole

    parser = expat.ParserCreate("utf-8")
    parser.StartElementHandler, parser.EndElementHandler, parser.StartDoctypeDeclHandler = start, stop, whole
    try:
        parser.Parse(body, True)
    except (_Whole, expat.ExpatError):
        if depth or not end:  # after the root's end nothing is read
            yield body
            return
    if starts:
        first = starts[0]
        for at in starts:
            if at - first >= size:
                yield before + body[first:at] + after
                first = at
        yield before + body[first:end] + after


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (source, error, form, body) as rows of their pieces; those without a form stay one row."""
    for batch in batches:
        rows, cut, size = [], [], 0

        def out(batch=batch) -> pa.RecordBatch:
            kept = batch.select(["source", "error", "form"]).take(pa.array(rows, pa.int64()))
            return pa.RecordBatch.from_arrays([*kept.columns, pa.array(cut, pa.binary()).view(pa.string())], ["source", "error", "form", "piece"])

        for i, (form, body) in enumerate(zip(batch["form"].to_pylist(), batch["body"], strict=True)):
            for piece in (None,) if form is None else pieces(body.as_buffer().to_pybytes(), form):
                rows.append(i)
                cut.append(piece)
                size += len(piece or b"")
                if size >= 16 * PIECE:
                    yield out()
                    rows, cut, size = [], [], 0
        if rows:
            yield out()


def items(docs: DataFrame, titled: bool = True) -> DataFrame:
    """source, error, title, summary, url, d of the items of feeds (source, body), RSS 2.0 or Atom by their root.

    Summaries without tags, cut to SUMMARY characters; d is null where the date can't be read; items without a title are left out (titled). A document
    that is null, empty, no XML or of another root gives one row with error "corrupt" and nulls; one without items gives none.
    """
    bounded_batches(docs.sparkSession)
    is_rss, is_atom = F.col("body").rlike(r"<(rss|rdf:RDF)[\s>]"), F.col("body").rlike(r"<feed[\s>]")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "ignoreNamespace": "true"}
    form = F.when(is_rss, F.lit("rss")).when(is_atom, F.lit("atom"))
    of = lambda body, rss, atom: (F.when(F.col("form") == "rss", F.from_xml(body, rss, options)).alias("r"), F.when(F.col("form") == "atom", F.from_xml(body, atom, options)).alias("a"))
    judged = docs.select("source", "body", form.alias("form")).select("source", "body", "form", *of("body", RSS_JUDGED, ATOM_JUDGED))
    wrong = F.coalesce(F.col("r._corrupt_record").isNotNull() | F.col("a._corrupt_record").isNotNull(), F.lit(False)) | (F.col("r").isNull() & F.col("a").isNull())
    told = judged.select("source", "body", "form", wrong.alias("wrong")).select("source", F.when(F.col("wrong"), F.lit("corrupt")).alias("error"), *[F.when(~F.col("wrong"), F.col(c)).alias(c) for c in ("form", "body")])
    kept = [f"source {docs.schema['source'].dataType.simpleString()}", "error string", "form string", "piece string"]
    read = told.mapInArrow(_cut, ", ".join(kept)).select("source", "error", *of("piece", RSS, ATOM))
    e = lambda name: F.col(f"e.{name}")
    item = lambda title, summary, url, date: F.struct(title.alias("title"), summary.alias("summary"), url.alias("url"), date.alias("date"))
    rss = F.transform("r.channel.item", lambda i: item(_first(i["title"]), _first(i["description"]), _first(i["link"], i["guid"]["_VALUE"]), _first(i["pubDate"])))
    atom = F.transform("a.entry", lambda i: item(_first(i["title"]["_VALUE"]), _first(i["summary"]["_VALUE"]), _first(F.get(i["link"]["_href"], F.lit(0))), _first(i["published"], i["updated"])))
    found = F.coalesce(rss, atom, F.array().cast("array<struct<title: string, summary: string, url: string, date: string>>"))
    none = F.lit(None).cast("struct<title: string, summary: string, url: string, date: string>")
    rows = read.select("source", "error", F.explode(F.when(F.col("error").isNotNull(), F.array(none)).otherwise(found)).alias("e"))
    clean = F.trim(F.left(F.regexp_replace(e("summary"), "<[^>]+>", ""), F.lit(SUMMARY)))
    out = rows.select("source", "error", e("title").alias("title"), clean.alias("summary"), e("url").alias("url"), F.to_date(text.parsed_date(e("date"))).alias("d"))
    return out.where(F.col("error").isNotNull() | (F.length("title") > 0)) if titled else out


def filings(docs: DataFrame) -> DataFrame:
    """source, error, company, form, d, cik, accession of search results (source, body: JSON). What is missing is a question mark, or "(sin nombre)".

    A document that is no JSON, or that tells of an error, gives one row with it.
    """
    read = docs.select("source", F.from_json("body", HITS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("j"))
    error = F.when(F.col("j").isNull() | F.col("j._corrupt_record").isNotNull(), F.lit("corrupt")).otherwise(F.col("j.error"))
    hits = F.coalesce(F.col("j.hits.hits"), F.array().cast("array<struct<_id: string, _source: struct<display_names: array<string>, root_forms: array<string>, ciks: array<string>, file_date: string>>>"))
    rows = read.select("source", error.alias("error"), F.explode(F.when(error.isNotNull(), F.array(F.get(hits, F.lit(-1)))).otherwise(hits)).alias("h"))
    of = lambda name, rest: F.when(F.col("error").isNull(), F.coalesce(F.get(F.col(f"h._source.{name}"), F.lit(0)), F.lit(rest)))
    day = F.when(F.col("error").isNull(), F.coalesce("h._source.file_date", F.lit("?")))
    return rows.select("source", "error", of("display_names", "(sin nombre)").alias("company"), of("root_forms", "?").alias("form"), day.alias("d"), of("ciks", "?").alias("cik"), F.split_part("h._id", F.lit(":"), F.lit(1)).alias("accession"))
