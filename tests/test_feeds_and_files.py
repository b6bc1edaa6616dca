import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidewell.operators import bootstrap, calendar
from tidewell.sources import feeds, files, sinks

RSS = '<?xml version="1.0"?><rss version="2.0"><channel><title>c</title><item><title>One &amp; two</title><description>&lt;p&gt;text&lt;/p&gt;</description><guid isPermaLink="false">g1</guid><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item><item><title> </title><link>l</link></item></channel></rss>'
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">Three</title><link rel="x" href="h3"/><link href="h4"/><published>2024-01-02T00:00:00Z</published></entry></feed>'


def test_feeds_keep_errors_by_source(spark):
    docs = [("rss", RSS), ("atom", ATOM), ("cut", RSS[:-20]), ("none", None), ("empty", ""), ("html", "<html><body>no</body></html>"), ("bare", '<rss version="2.0"><channel><title>c</title></channel></rss>'), ("json", "{}")]
    got = sorted(tuple(None if x is None else str(x) for x in r) for r in feeds.items(spark.createDataFrame(docs, "source string, body string")).collect())
    broken = [(s, "corrupt", None, None, None, None) for s in ("cut", "none", "empty", "html", "json")]
    assert got == sorted([("rss", None, "One & two", "text", "g1", "2024-01-01"), ("atom", None, "Three", "", "h3", "2024-01-02"), *broken], key=lambda r: r[0])


def test_nothing_of_a_feed_is_copied_with_each_of_its_items(spark):
    node = feeds.items(spark.createDataFrame([("rss", RSS)], "source string, body string"))._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Generate":
        node = node.children().head()
    carried = node.requiredChildOutput()
    assert {carried.apply(i).name() for i in range(carried.size())} == {"source", "error"}


def test_long_feeds_are_read_by_pieces(spark):
    rss = "".join(f"<item><title>{i}{' x' * 200}</title></item><!-- <item> -->" for i in range(3000))
    odd = "<title>c</title><group><item><title>no</title></item></group><item><title><![CDATA[</item><item>]]></title></item><item a='>'/>"
    docs = {
        "long": f'<rss version="2.0"><channel>{rss}</channel></rss>',
        "cut": f'<rss version="2.0"><channel>{rss}</channel></rs',
        "bad": f'<rss version="2.0"><channel>{rss}<item><title>a & b</title></item></channel></rss>',
        "odd": f"<rss ><channel>{rss}</channel><x:channel>{odd}<x:ITEM><title>last</title></x:ITEM></x:channel></rss>tail",
        "atom": f"<feed ><title>c</title>{'<entry><title>e</title><entry><title>in</title></entry></entry>' * 9000}</feed>",
        "dtd": f'<!DOCTYPE rss><rss version="2.0"><channel>{rss}</channel></rss>',
    }
    got = feeds.items(spark.createDataFrame(list(docs.items()), "source string, body string")).groupBy("source", "error").agg(F.count("*").alias("n"), F.countDistinct("title").alias("titles"), F.min("title").alias("least")).collect()
    assert {r["source"]: (r["error"], r["n"], r["titles"]) for r in got} == {"long": (None, 3000, 3000), "cut": ("corrupt", 1, 0), "bad": ("corrupt", 1, 0), "odd": (None, 2, 2), "atom": (None, 9000, 1), "dtd": (None, 3000, 3000)}
    assert {r["source"]: r["least"] for r in got if r["source"] in ("odd", "atom")} == {"odd": "</item><item>", "atom": "e"}
    cut = list(feeds.pieces(docs["long"].encode(), "rss", 10_000))
    assert len(cut) > 100 and max(map(len, cut)) < 11_000 and sum(c.count(b"</item>") for c in cut) == 3000


def test_bytes_that_are_no_utf8_are_no_end_of_other_feeds(spark):
    docs = spark.createDataFrame([("bad", RSS.replace("One", "On\u00e9").encode("latin-1")), ("good", RSS.encode())], "source string, body binary").select("source", F.expr("CAST(body AS STRING)").alias("body"))
    assert sorted((r["source"], r["title"]) for r in feeds.items(docs).collect()) == [("bad", "On\ufffd & two"), ("good", "One & two")]


def test_filings(spark):
    hit = {"_id": "0001-24-1:x.htm", "_source": {"display_names": ["ACME (A)"], "root_forms": ["8-K"], "ciks": ["0012"], "file_date": "2024-02-03"}}
    docs = [("a", json.dumps({"hits": {"hits": [hit, {"_id": "2", "_source": {"display_names": []}}]}})), ("b", '{"error": "too many"}'), ("c", "{"), ("d", '{"hits": {"hits": []}}')]
    got = sorted(map(tuple, feeds.filings(spark.createDataFrame(docs, "source string, body string")).collect()), key=str)
    assert got == sorted([("a", None, "ACME (A)", "8-K", "2024-02-03", "0012", "0001-24-1"), ("a", None, "(sin nombre)", "?", "?", "?", "2"), ("b", "too many", *[None] * 5), ("c", "corrupt", *[None] * 5)], key=str)


def test_one_csv_file_whatever_its_parts(spark, tmp_path):
    rows = [(i, f'a,"{i}"' if i % 3 else None, i / 7) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, s string, v double").repartition(5)
    want = "k,s,v\n" + "".join(f"{k},{'' if s is None else '\"' + s.replace('\"', '\"\"') + '\"'},{v:.3f}\n" for k, s, v in rows)
    for parts in (1, 7):
        path = str(tmp_path / f"d{parts}/x.csv")
        r = sinks.write_csv_file(df.repartition(parts), path, ["k"], {"v": "%.3f"}).first()
        assert open(path).read() == want and (r["rows"], r["bytes"], r["sha256"]) == (500, len(want), hashlib.sha256(want.encode()).hexdigest())
        assert [p.name for p in (tmp_path / f"d{parts}").iterdir() if not p.name.startswith(".")] == ["x.csv"]
    assert sinks.write_csv_file(df.where("false"), str(tmp_path / "e.csv"), ["k"]).first()["rows"] == 0 and open(tmp_path / "e.csv").read() == "k,s,v\n"


def test_leaves_of_any_depth(spark):
    docs = [(1, '{"a":' * 30 + "[7, {\"b\": null}]" + "}" * 30), (2, "[]"), (3, "5"), (4, None)]
    df = spark.createDataFrame(docs, "k int, j string").select("k", F.parse_json("j").alias("doc"))
    assert sorted(map(tuple, files.leaves(df, "k", "doc").collect())) == [(1, "$" + ".a" * 30 + "[0]", "7"), (1, "$" + ".a" * 30 + "[1].b", None), (3, "$", "5")]


def test_stationary_places(spark):
    got = bootstrap.stationary_places(spark.createDataFrame([("s", 400), ("t", 1)], "series string, n long"), 30, 20.0).orderBy("series", "draw", "place").collect()
    own = [r for r in got if r["series"] == "s"]
    assert len(own) == 30 * 400 and len(got) == len(own) + 30
    for a, b in zip(own, own[1:]):
        if b["place"]:
            assert b["starts"] or b["source"] == (a["source"] + 1) % 400
        else:
            assert b["starts"]
    assert 16 < 30 * 400 / sum(r["starts"] for r in own) < 25 and 180 < sum(r["source"] for r in own) / len(own) < 220


def test_many_series_are_one_scan(spark, tmp_path):
    for name, days in (("a b", 3), ("c", 2)):
        (tmp_path / f"in/series={name}").mkdir(parents=True)
        for part, close in (("0", 1), ("1", 5)):  # the second file repeats the days
            (tmp_path / f"in/series={name}/{part}.csv").write_text("fecha,cierre\n" + "".join(f"2024-01-0{d + 1},{close + d}\n" for d in range(days)))
    path = str(tmp_path / "in")
    got = sorted((r["series"], r["d"].day, r["close"]) for r in files.load_bars(spark, path, None, least=2).collect())
    assert got == [("a b", 1, 1.0), ("a b", 2, 2.0), ("a b", 3, 3.0), ("c", 1, 1.0), ("c", 2, 2.0)]
    assert {r["close"] for r in files.load_bars(spark, path, None, least=2, keep="last").where("series = 'c'").collect()} == {5.0, 6.0}
    assert files.load_metric(spark, path, None).count() == 10
    try:
        files.load_bars(spark, path, None, least=3)
        raise AssertionError
    except ValueError as e:
        assert "2 days of c" in str(e)


def test_anchored_files_fail_before_a_row_is_read(spark, tmp_path):
    for series, text in (("a", "fecha,a\u00f1o\n2024-01-01,1.5\n"), ("b", "fecha,a\u00f1o\n2024-01-01,2\n")):
        (tmp_path / f"series={series}").mkdir()
        (tmp_path / f"series={series}/x.csv").write_bytes(text.encode("latin-1"))
    own = {r["series"]: r["sha256"] for r in files.file_hashes(spark, str(tmp_path)).collect()}
    assert own["a"] == hashlib.sha256("fecha,a\u00f1o\n2024-01-01,1.5\n".encode("latin-1")).hexdigest()
    listed = lambda pairs: spark.createDataFrame(list(pairs.items()), "series string, sha256 string")
    load = lambda pairs: files.load_metric(spark, str(tmp_path), None, encoding="ISO-8859-1", anchors=listed(pairs)).collect()
    assert sorted((r["series"], r["value"]) for r in load(own)) == [("a", 1.5), ("b", 2.0)]
    for wrong, word in (({**own, "b": "0"}, "b changed"), ({**own, "c": "0"}, "c absent"), ({"a": own["a"]}, "b unexpected"), ({**own, "a": None}, "a changed")):
        with pytest.raises(ValueError, match=word):
            load(wrong)
    (tmp_path / "series=a/y.csv").write_text("fecha,x\n")
    with pytest.raises(ValueError, match="a changed"):
        load(own)


def test_latest_records_of_many_logs(spark, tmp_path):
    logs = {"one": '[{"n": 1, "t": "2024-01-01", "x": "a"}, {"n": 2, "t": "2024-01-02", "x": " "}]', "two": '[{"n": 3, "t": "2024-01-01", "x": "a"}, {"n": 4, "t": "2024-01-01", "x": "b"}, {"n": 5, "x": "c"}]', "cut": '[{"n": 6, "t": "2024', "none": "[]"}
    for name, body in logs.items():
        (tmp_path / f"log={name}").mkdir()
        (tmp_path / f"log={name}/r.json").write_text(body)
    got = files.latest_records(spark, str(tmp_path), "n long, t string, x string", text="x", order=("t", "n"))
    assert sorted((r["log"], r["n"]) for r in got.collect()) == [("one", 1), ("two", 4)]


def test_agenda_of_days_with_ties_nulls_and_an_end(spark):
    day = lambda text: dt.date.fromisoformat(text)
    events = spark.createDataFrame([(day("2024-01-05"), "B", "alta"), (day("2024-01-05"), "A", "media"), (day("2024-01-20"), "C", "alta"), (day("2024-06-01"), "D", "alta")], "d date, kind string, weight string")
    days = spark.createDataFrame([(1, day("2024-01-05")), (2, day("2024-01-06")), (3, day("2025-01-01")), (4, None)], "id int, today date")
    got = sorted((r["id"], r["kind"], r["days"]) for r in calendar.agenda(events, days, horizon=90, most=2).collect())
    assert got == [(1, "A", 0), (1, "B", 0), (2, "C", 14)]
