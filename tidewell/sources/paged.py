"""Series behind a paged interface, as batches and as a stream: a request names a cursor and gets one page of rows.

Each task walks the pages of one stretch of one series, forward (the next cursor is the last time and a step) or backward (the first time less a step),
and keeps the rows of its stretch. A cursor that a page doesn't move, a page of another form, or more requests than allowed end the job with PageError:
nothing is returned by half. The driver sees the names of series and of their last pages, never rows.

Defined cases: a series without pages gives no rows; pages may overlap, and of rows that disagree
the one that its stretch asked for last counts (`latest`); values stay the text that the page holds (null where a field is absent); rows of
one time must lie in one page, since the cursor goes beyond them.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidewell.session import ship
from tidewell.sources.sinks import store_of

DAY = 86_400


class PageError(ValueError):
    """A page that can't be read, or a walk that doesn't come to its end."""


class SavedPages:
    """Responses saved as path/series=<name>/page=<first time>_<last time>/<file>, each one JSON document.

    Another transport has the same three methods; an answer is what the server said, the walk judges it.
    """

    def __init__(self, path: str) -> None:
        self.store, self.root = store_of(path)
        self.names: dict[str, list[tuple[int, int, str]]] = {}

    def series(self) -> list[str]:
        found = self.store.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        return sorted(unquote(x.base_name[7:]) for x in found if x.base_name.startswith("series="))

    def pages(self, series: str) -> list[tuple[int, int, str]]:
        if series not in self.names:
            folders = [x for x in self.store.get_file_info(fs.FileSelector(self.root)) if x.base_name.startswith("series=") and unquote(x.base_name[7:]) == series]
            inside = [x for f in folders for x in self.store.get_file_info(fs.FileSelector(f.path)) if x.base_name.startswith("page=")]
            self.names[series] = sorted((*map(int, x.base_name[5:].split("_")), x.path) for x in inside)
        return self.names[series]

    def last(self, series: str) -> int | None:
        """The last time that there is."""
        return max((last for _, last, _ in self.pages(series)), default=None)

    def ask(self, series: str, cursor: int, backward: bool) -> object | None:
        """The page that holds the rows from the cursor on (or up to it), None where there is none."""
        pages = self.pages(series)
        i = bisect_right([p[0] for p in pages], cursor) - 1 if backward else bisect_left([p[1] for p in pages], cursor)
        if not 0 <= i < len(pages):
            return None
        files = [x for x in self.store.get_file_info(fs.FileSelector(pages[i][2])) if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))]
        text = b"".join(self.store.open_input_stream(x.path).read() for x in sorted(files, key=lambda x: x.path))
        return json.loads(text, parse_float=str, parse_int=str)


def rows_of(answer: object, where: str, time: str) -> list[tuple[int, dict]]:
    """(time, row) of the list that lies at the dotted path in an answer."""
    for key in filter(None, where.split(".")):
        answer = answer.get(key) if isinstance(answer, dict) else None
    if not isinstance(answer, list):
        raise PageError(f"a page has no list at '{where}'")
    try:
        return [(int(r[time]), r) for r in answer]
    except (KeyError, TypeError, ValueError) as e:
        raise PageError(f"a row has no whole number as '{time}'") from e


def walk(pages: SavedPages, series: str, start: int, end: int, where: str, time: str, step: int, backward: bool, most: int) -> Iterator[tuple[int, int, int, dict]]:
    """(time, request, place, row) from start up to, not including, end."""
    cursor = end - 1 if backward else start
    request = 0
    while start <= cursor < end:
        if request == most:
            raise PageError(f"{series}: {most} requests don't cover {start} to {end}")
        answer = pages.ask(series, cursor, backward)
        found = [] if answer is None else rows_of(answer, where, time)
        if not found:
            return
        yield from ((t, request, place, row) for place, (t, row) in enumerate(found) if start <= t < end)
        times = [t for t, _ in found]
        if (min(times) > cursor) if backward else (max(times) < cursor):
            raise PageError(f"{series}: the page at {cursor} doesn't move the cursor")
        cursor = min(times) - step if backward else max(times) + step
        request += 1


class Stretch(InputPartition):
    def __init__(self, series: str, start: int, end: int) -> None:
        self.series, self.start, self.end = series, start, end


class _Walker:
    """What batches and streams share: options, stretches and the walk of one of them."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        o = {k.lower(): v for k, v in options.items()}
        self.path, self.where, self.time = o["path"], o.get("rows", ""), o.get("time", "timestamp")
        self.step, self.span, self.most = int(o.get("step", 1)), int(o.get("span", 1000 * DAY)), int(o.get("requests", 40))
        self.start, self.until = int(o.get("from", 0)), int(o["until"]) if "until" in o else None
        self.backward = o.get("backward", "false").lower() == "true"
        self.fields = schema.names[4:]

    def ends(self) -> dict[str, int]:
        """How far each series goes."""
        pages = SavedPages(self.path)
        found = {s: pages.last(s) for s in pages.series()}
        return {s: last + 1 if self.until is None else min(last + 1, self.until) for s, last in found.items() if last is not None}

    def stretches(self, starts: dict[str, int], ends: dict[str, int]) -> list[Stretch]:
        every = [(s, starts.get(s, self.start), end) for s, end in sorted(ends.items())]
        return [Stretch(s, a, min(a + self.span, end)) for s, start, end in every for a in range(start, end, self.span)]

    def read(self, partition: Stretch | None) -> Iterator[tuple]:
        p = partition
        if p is None:  # how a source without partitions is asked
            return
        for t, request, place, row in walk(SavedPages(self.path), p.series, p.start, p.end, self.where, self.time, self.step, self.backward, self.most):
            yield (p.series, t, request, place, *(None if row.get(c) is None else str(row[c]) for c in self.fields))


class _Reader(_Walker, DataSourceReader):
    def partitions(self) -> list[Stretch]:
        return self.stretches({}, self.ends())


class _StreamReader(_Walker, DataSourceStreamReader):
    """Offsets: the time up to which each series has been read. They come from the pages alone, so a restart finds the same ones."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.ends()

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return self.stretches(start, end)


class PagedSource(DataSource):
    """Options: path, fields (by commas), rows (dotted path of the list), time (its field), step, span (of a task), requests (most of a task), from, until, backward."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        fields = [c for c in self.options.get("fields", "").split(",") if c]
        return ", ".join(["series string", "t long", "request int", "place int", *(f"`{c}` string" for c in fields)])

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options, schema)

    def streamReader(self, schema: StructType) -> _StreamReader:
        return _StreamReader(self.options, schema)


def _options(spark: SparkSession, path: str, fields: list[str], given: dict) -> dict[str, str]:
    ship(spark)
    spark.dataSource.register(PagedSource)
    return {"path": path, "fields": ",".join(fields), **{k.rstrip("_"): str(v) for k, v in given.items()}}


def read(spark: SparkSession, path: str, fields: list[str], **given: object) -> DataFrame:
    """series, t, request, place and the fields as text; from is given as from_."""
    return spark.read.format("pages").options(**_options(spark, path, fields, given)).load()


def stream(spark: SparkSession, path: str, fields: list[str], **given: object) -> DataFrame:
    """The same as a stream: a batch takes what has come to each series since the last one."""
    return spark.readStream.format("pages").options(**_options(spark, path, fields, given)).load()


def save(df: DataFrame, path: str, rows: str = "", time: str = "timestamp", span: int = 1000 * DAY) -> None:
    """df (series, t, fields) as saved responses, a page for each span of time; pages that are there stay."""
    inner = F.struct(F.col("t").cast("string").alias(time), *[c for c in df.columns if c not in ("series", "t")])
    page = F.concat_ws("_", F.min("t"), F.max("t"))
    each = df.groupBy("series", F.floor(F.col("t") / span).alias("_span")).agg(page.alias("page"), F.array_sort(F.collect_list(F.struct("t", inner.alias("row")))).alias("_rows"))
    body = F.col("_rows.row")
    for key in reversed([k for k in rows.split(".") if k]):
        body = F.struct(body.alias(key))
    each.select(F.to_json(body).alias("value"), "series", "page").write.mode("append").partitionBy("series", "page").text(path)


def latest(df: DataFrame) -> DataFrame:
    """One row a series and time: the one asked for last, in a page the later one."""
    return df.groupBy("series", "t").agg(F.max_by(F.struct(*[c for c in df.columns if c not in ("series", "t", "request", "place")]), F.struct("request", "place")).alias("_r")).select("series", "t", "_r.*")


def daily_bars(df: DataFrame, unit: int = 1) -> DataFrame:
    """series, d, open, high, low, close of pages whose times are seconds (or unit a second); bars without a high and low above 0 are left out.

    A day with several bars keeps the one that was asked for last; an open or close that is no number is null.
    """
    number = {c: F.expr(f"try_cast(`{c}` AS double)") for c in ("open", "high", "low", "close")}
    x = df.select("series", F.to_date(F.timestamp_seconds((F.col("t") / unit).cast("long"))).alias("t"), "request", "place", *[v.alias(c) for c, v in number.items()])
    return latest(x.where("high > 0 AND low > 0")).withColumnRenamed("t", "d")


def daily_sums(df: DataFrame, field: str, unit: int = 1000) -> DataFrame:
    """series, d, value: sums of a field by day, 0 on days between that have none; what is no number adds nothing."""
    x = latest(df).select("series", F.to_date(F.timestamp_seconds(F.floor(F.col("t") / unit))).alias("d"), F.expr(f"try_cast(`{field}` AS double)").alias("x"))
    sums = x.groupBy("series", "d").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("value"))
    last = F.coalesce(F.date_sub(F.lead("d").over(W.partitionBy("series").orderBy("d")), 1), F.col("d"))
    every = sums.withColumn("last", last).select("series", "d", "value", F.explode(F.sequence("d", "last")).alias("day"))
    return every.select("series", F.col("day").alias("d"), F.when(F.col("day") == F.col("d"), F.col("value")).otherwise(0.0).alias("value"))
