import json

import pytest
from pyspark.sql import functions as F

from tidewell.sources import paged
from tidewell.streaming import ticks

FIELDS = ["close", "high"]


def saved(folder, series, first, last, rows):
    place = folder / f"series={series}" / f"page={first}_{last}"
    place.mkdir(parents=True)
    (place / "a.json").write_text(json.dumps(rows))


def rows(*times, close="1.50"):
    return {"data": {"ohlc": [{"timestamp": str(t), "close": close, "high": 2} for t in times]}}


def read(spark, folder, **given):
    return paged.read(spark, str(folder), FIELDS, rows="data.ohlc", **given)


@pytest.fixture
def folder(tmp_path):
    saved(tmp_path, "a b", 0, 20, rows(0, 10, 20))
    saved(tmp_path, "a b", 20, 40, rows(20, 30, 40, close="7"))  # overlaps the page before
    saved(tmp_path, "c", 50, 50, rows(50))
    return tmp_path


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("span", [7, 25, 10_000])
def test_every_row_in_both_directions_and_any_stretches(spark, folder, backward, span):
    got = read(spark, folder, backward=backward, span=span, step=10)
    assert sorted((r["series"], r["t"]) for r in paged.latest(got).collect()) == [("a b", t) for t in (0, 10, 20, 30, 40)] + [("c", 50)]
    kept = {r["t"]: (r["close"], r["high"]) for r in paged.latest(got).where("series = 'a b'").collect()}
    assert kept[10] == ("1.50", "2") and kept[30] == ("7", "2")  # the text as it was
    if span == 10_000:  # one walk: the page asked for last holds it, going back that is the older one
        assert kept[20] == (("1.50", "2") if backward else ("7", "2"))


def test_bounds(spark, folder):
    assert sorted(r["t"] for r in paged.latest(read(spark, folder, from_=10, until=40, step=10)).collect()) == [10, 20, 30]
    assert read(spark, folder, from_=60).count() == 0


def test_no_pages_and_an_empty_page(spark, tmp_path):
    assert read(spark, tmp_path / "none").count() == 0
    saved(tmp_path, "a", 0, 9, rows())
    assert read(spark, tmp_path).count() == 0


@pytest.mark.parametrize("backward", [False, True])
def test_a_cursor_that_stands_still(spark, tmp_path, backward):
    saved(tmp_path, "a", *((0, 9) if backward else (0, 99)), rows(50, 60) if backward else rows(0, 10))
    with pytest.raises(Exception, match="doesn't move the cursor"):
        read(spark, tmp_path, backward=backward, until=10 if backward else 100).collect()


def test_too_many_requests_give_nothing(spark, tmp_path):
    for t in range(0, 50, 10):
        saved(tmp_path, "a", t, t, rows(t))
    with pytest.raises(Exception, match="4 requests don't cover"):
        read(spark, tmp_path, requests=4).collect()
    assert read(spark, tmp_path, requests=5).count() == 5


@pytest.mark.parametrize("bad", [{"error": "no"}, {"data": []}, {"data": {"ohlc": {}}}, {"data": {"ohlc": [{"close": "1"}]}}, {"data": {"ohlc": [None]}}])
def test_pages_of_another_form(spark, tmp_path, bad):
    saved(tmp_path, "a", 0, 9, bad)
    with pytest.raises(Exception, match="PageError"):
        read(spark, tmp_path).collect()


def test_stream_through_a_restart(spark, tmp_path):
    place, out, check = (tmp_path / x for x in ("in", "out", "check"))
    df = spark.range(200).select(F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("series"), F.col("id").alias("t"), F.col("id").cast("string").alias("close"))
    for part in (df.where("t < 70"), df.where("t >= 70 AND series = 'x'"), df.where("t >= 70 AND series = 'y'").union(df.where("t < 5").withColumn("series", F.lit("z")))):
        paged.save(part, str(place), span=20)
        got = paged.stream(spark, str(place), ["close"], span=30)
        ticks.appended(got, str(out), str(check)).awaitTermination()  # each time a new start
    ticks.appended(paged.stream(spark, str(place), ["close"], span=30), str(out), str(check)).awaitTermination()  # nothing new
    back = sorted((r["series"], r["t"], r["close"]) for r in spark.read.parquet(str(out)).collect())
    assert back == sorted([(r["series"], r["t"], r["close"]) for r in df.collect()] + [("z", t, str(t)) for t in range(5)])


def test_daily(spark):
    cells = [("a", 0, 0, 0, "1", "2", "1", "1"), ("a", 60, 1, 0, "1", "3", "1", "9"), ("a", 86_400, 0, 1, "1", "0", "0", "1"), ("a", 3 * 86_400, 0, 2, "x", "2", "1", None)]
    df = spark.createDataFrame(cells, "series string, t long, request int, place int, open string, high string, low string, close string")
    assert sorted((str(r["d"]), r["open"], r["close"]) for r in paged.daily_bars(df).collect()) == [("1970-01-01", 1.0, 9.0), ("1970-01-04", None, None)]
    sums = paged.daily_sums(df, "close", 1)
    assert sorted((str(r["d"]), r["value"]) for r in sums.collect()) == [("1970-01-01", 10.0), ("1970-01-02", 1.0), ("1970-01-03", 0.0), ("1970-01-04", 0.0)]
