"""Time axes: calendars, gaps and their consequences, episodes, segments, agendas."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import series as S

# Halvings and the next one's estimate, the window of days after one, the days of notice before it.
HALVINGS = ["2012-11-28", "2016-07-09", "2020-05-11", "2024-04-20", "2028-04-20"]
WINDOW_START, WINDOW_END, NOTICE = 545, 730, 90
# Meetings (with projections or without) and inflation dates.
FOMC = [
    ("2026-09-16", True), ("2026-10-28", False), ("2026-12-09", True), ("2027-01-27", False), ("2027-03-17", True), ("2027-04-28", False),
    ("2027-06-09", True), ("2027-07-28", False), ("2027-09-15", True), ("2027-10-27", False), ("2027-12-08", True),
]
CPI = ["2026-09-11", "2026-10-13", "2026-11-10", "2026-12-10"]


def days(df: DataFrame) -> DataFrame:
    """series, d: every day from a series' first to its last."""
    ends = df.groupBy("series").agg(F.min("d").alias("a"), F.max("d").alias("z"))
    return ends.select("series", F.explode(F.sequence("a", "z")).alias("d"))


def business_days(df: DataFrame) -> DataFrame:
    return days(df).where(F.weekday("d") < 5)


def reindexed(df: DataFrame) -> DataFrame:
    """df on the daily calendar of its series; nulls on missing days."""
    return days(df).join(df, ["series", "d"], "left")


def missing(calendar: DataFrame, df: DataFrame) -> DataFrame:
    return calendar.join(df.select("series", "d"), ["series", "d"], "left_anti")


def runs(dates: DataFrame) -> DataFrame:
    """series, a, z, n: runs of consecutive days."""
    island = F.date_sub("d", F.row_number().over(S.ordered()))
    return dates.withColumn("i", island).groupBy("series", "i").agg(F.min("d").alias("a"), F.max("d").alias("z"), F.count("*").alias("n")).drop("i")


def nulled_days(df: DataFrame, least: int = 3, after: int = 20) -> DataFrame:
    """Days of df that a gap of least days or more makes unusable: those up to after calendar days behind it."""
    gaps = runs(missing(days(df), df)).where(F.col("n") >= least)
    spread = gaps.select("series", F.explode(F.sequence(F.col("a"), F.date_add("z", after))).alias("d")).distinct()
    return df.select("series", "d").join(spread, ["series", "d"], "left_semi")


def continuity(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Each series' expected and missing days, coverage and longest gap of its calendar."""
    gaps = missing(calendar, df)
    order = calendar.withColumn("i", F.row_number().over(S.ordered())).join(gaps.withColumn("gap", F.lit(True)), ["series", "d"], "left")
    island = order.where("gap").withColumn("k", F.col("i") - F.row_number().over(S.ordered()))
    longest = island.groupBy("series", "k").agg(F.count("*").alias("n")).groupBy("series").agg(F.max("n").alias("longest"))
    counts = order.groupBy("series").agg(F.count("*").alias("expected"), F.count("gap").alias("missing"))
    return counts.join(longest, "series", "left").select(
        "series", "expected", "missing", *S.rounded(coverage=1 - F.col("missing") / F.col("expected")), F.coalesce("longest", F.lit(0)).cast("long").alias("longest")
    )


def episodes(active: DataFrame, most_gap: int = 30) -> DataFrame:
    """series, episode, a, z, n: active days whose distances don't exceed most_gap days belong together."""
    new = F.coalesce((F.date_diff("d", S.before(F.col("d"))) > most_gap).cast("int"), F.lit(1))
    numbered = active.withColumn("new", new).withColumn("episode", F.sum("new").over(S.so_far()).cast("int"))
    return numbered.groupBy("series", "episode").agg(F.min("d").alias("a"), F.max("d").alias("z"), F.count("*").alias("n"))


def segments(df: DataFrame, n: int = 4) -> DataFrame:
    """series, segment, a, z: n spans of equal length, borders rounded half to even, both ends inclusive."""
    ends = df.groupBy("series").agg(F.min("d").alias("first"), F.max("d").alias("last"))
    border = lambda k: F.date_add("first", F.bround(F.date_diff("last", "first") * k / n).cast("int"))
    cut = ends.select("series", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("segment"), "first", "last")
    end = F.when(F.col("segment") == n, border(F.col("segment"))).otherwise(F.date_sub(border(F.col("segment")), 1))
    return cut.select("series", "segment", border(F.col("segment") - 1).alias("a"), end.alias("z"))


def in_segments(df: DataFrame, n: int = 4) -> DataFrame:
    """df with the segment of each row."""
    joined = df.join(segments(df, n).withColumnRenamed("series", "_s"), (F.col("series") == F.col("_s")) & F.col("d").between(F.col("a"), F.col("z")))
    return joined.drop("_s", "a", "z")


def halves(df: DataFrame, least_years: float = 2.0) -> DataFrame:
    """Where each series is cut in two blocks of equal span, and whether both are long enough."""
    ends = df.groupBy("series").agg(F.min("d").alias("first"), F.max("d").alias("last"))
    cut = ends.withColumn("cut", F.date_add("first", F.floor(F.date_diff("last", "first") / 2).cast("int")))
    x = df.select("series", "d").join(cut, "series")
    one = F.when(F.col("d") <= F.col("cut"), F.col("d"))
    two = F.when(F.col("d") > F.col("cut"), F.col("d"))
    years = lambda c: F.coalesce(F.date_diff(F.max(c), F.min(c)), F.lit(0)) / 365.25
    got = x.groupBy("series", "cut").agg(F.count(one).alias("n1"), F.count(two).alias("n2"), years(one).alias("y1"), years(two).alias("y2"))
    return got.select("series", "cut", "n1", "n2", F.round("y1", 2).alias("years1"), F.round("y2", 2).alias("years2"), ((F.col("y1") >= least_years) & (F.col("y2") >= least_years)).alias("enough"))


def quarter(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))


def forward_blocks(last: DataFrame, n: int = 5, length: int = 91, eligible: int = 61) -> DataFrame:
    """last: series, z. n consecutive blocks of length days from the day after z, the first eligible days of each may be used."""
    k = F.col("block") - 1
    blocks = last.select("series", "z", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("block"))
    start = F.date_add("z", (1 + k * length).cast("int"))
    return blocks.select("series", "block", start.alias("a"), F.date_add(start, length - 1).alias("end"), F.date_add(start, eligible - 1).alias("last_eligible"))


def frequency(df: DataFrame) -> DataFrame:
    """Mean days between rows and what that makes the series."""
    got = df.groupBy("series").agg((F.date_diff(F.max("d"), F.min("d")) / F.greatest(F.count("*") - 1, F.lit(1))).alias("mean_days"))
    label = F.when(F.col("mean_days") > 20, "monthly").when(F.col("mean_days") > 5, "weekly").otherwise("daily")
    return got.select("series", *S.rounded(mean_days=F.col("mean_days")), label.alias("frequency"))


def halving_phase(dates: DataFrame) -> DataFrame:
    """dates: d (and more). The last halving before it, days since, and whether its window is far, near or open."""
    past = F.array(*[F.lit(dt.date.fromisoformat(h)) for h in HALVINGS])
    x = dates.withColumn("halving", F.array_max(F.filter(past, lambda h: h <= F.col("d"))))
    since = F.date_diff("d", "halving")
    state = F.when(since.isNull() | (since < WINDOW_START - NOTICE) | (since > WINDOW_END), "silencio").when(since < WINDOW_START, "aproximandose").otherwise("en_ventana")
    inside = state != "silencio"
    return x.select(
        *dates.columns, "halving", since.alias("since"), state.alias("state"),
        F.when(inside, F.greatest(WINDOW_START - since, F.lit(0))).alias("days_to_window"),
        F.when(inside, F.greatest(WINDOW_END - since, F.lit(0))).alias("days_left"),
    )


def events(spark) -> DataFrame:
    rows = [(dt.date.fromisoformat(d), "FOMC", "alta" if big else "media") for d, big in FOMC] + [(dt.date.fromisoformat(d), "CPI", "alta") for d in CPI]
    return spark.createDataFrame(rows, "d date, kind string, weight string")


def agenda(events_: DataFrame, dates: DataFrame, horizon: int = 90, most: int = 6) -> DataFrame:
    """dates: today (and more). For each of its rows the next most events; of these, those within horizon days: dates' columns, d, kind, weight, days.

    The events are one calendar, which goes to the rows as one array; a row without a date has no agenda.
    """
    listed = events_.agg(F.array_sort(F.collect_list(F.struct("d", "kind", "weight"))).alias("_events"))
    coming = F.slice(F.filter("_events", lambda e: e["d"] >= F.col("today")), 1, most)
    got = dates.join(F.broadcast(listed)).select(*dates.columns, F.inline(coming))
    return got.withColumn("days", F.date_diff("d", "today")).where(F.col("days") <= horizon)
