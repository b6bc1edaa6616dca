import threading

import pytest
from pyspark.sql import functions as F

from tidewell.sources import versions as V
from tidewell.streaming import ticks

SCHEMA = "k int, s string"


def rows(spark, path, version=None):
    return sorted(((r["k"], r["s"]) for r in V.read(spark, path, version).collect()), key=str)


def df(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


@pytest.mark.parametrize("step", ["before data", "data written", "manifest staged", "published"])
def test_a_stop_at_any_step_leaves_the_old_or_the_new_version(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    V.upsert(spark, path, df(spark, (1, "a"), (2, "b")), "k", ("w", 0))
    old, new = [(1, "a"), (2, "b")], [(1, "a"), (2, "c"), (3, "d")]

    def stop(at):
        if at == step:
            raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(V, "_reached", stop)
        with pytest.raises(RuntimeError, match="stopped"):
            V.upsert(spark, path, df(spark, (2, "c"), (3, "d")), "k", ("w", 1))
    assert rows(spark, path) == (new if step == "published" else old)
    V.upsert(spark, path, df(spark, (2, "c"), (3, "d")), "k", ("w", 1))  # the batch runs again
    assert rows(spark, path) == new and len(V.versions(spark, path)) == 2
    V.vacuum(spark, path, keep=1, older_than=0)
    assert rows(spark, path) == new and len(V.versions(spark, path)) == 1
    used = {f.split("/")[0] for f in V.manifest(spark, path)["folders"].values()}
    assert {n for n, _ in V.Folder(spark, path).names("") if n.startswith("data-")} == used


def test_readers_keep_their_version_and_batches_count_once(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        V.read(spark, path)
    assert V.upsert(spark, path, df(spark), "k") == 0 and rows(spark, path) == []
    V.upsert(spark, path, df(spark, *[(i, "x") for i in range(40)], (None, "n")), "k", ("w", 5))
    before = V.read(spark, path)
    untouched = V.manifest(spark, path)["folders"]
    assert V.upsert(spark, path, df(spark, (7, "y"), (None, "m")), "k", ("w", 6)) == 2
    assert V.upsert(spark, path, df(spark, (7, "z")), "k", ("w", 6)) == 2 and V.upsert(spark, path, df(spark, (7, "z")), "k", ("w", 5)) == 2
    now = V.manifest(spark, path)["folders"]
    assert sum(now[b] != untouched[b] for b in untouched) <= 2 < len(untouched)  # the other buckets lie where they lay
    assert dict(rows(spark, path))[7] == "y" and dict(rows(spark, path))[None] == "m" and len(rows(spark, path)) == 41
    assert {r["s"] for r in before.collect()} == {"x", "n"} and rows(spark, path, 0) == []
    assert V.upsert(spark, path, df(spark, (7, "z")), "k", ("other", 0)) == 3 and dict(rows(spark, path))[7] == "z"
    with pytest.raises(ValueError):
        V.read(spark, path, 9)


def test_writers_at_once_lose_nothing(spark, tmp_path):
    path, failed = str(tmp_path / "t"), []

    def write(i):
        try:
            V.upsert(spark, path, df(spark, (i, "x"), (100, str(i))), "k", buckets=2)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and {k for k, _ in rows(spark, path)} == {0, 1, 2, 3, 100} and V.versions(spark, path) == [0, 1, 2, 3]


def test_other_stores_rename_without_replacing(spark, tmp_path):
    folder = V.Folder(spark, str(tmp_path))
    folder.put("a", "1")
    folder.put("b", "2")
    folder.root = folder.root.replace("file:/", "file:///", 1)
    plain, V.urlparse = V.urlparse, lambda x: plain("hdfs:" + x)  # takes the way of shared stores
    try:
        folder.publish("a", "c")
        with pytest.raises(V.Taken):
            folder.publish("b", "c")
    finally:
        V.urlparse = plain
    assert folder.text("c") == "1"


def test_a_replayed_stream_leaves_the_same_rows(spark, tmp_path):
    source = spark.createDataFrame([("a", "2024-01-01", 1), ("b", "2024-01-02", 2), ("a", "2024-01-03", 3)], "series string, t string, value int").select("series", F.to_timestamp("t").alias("ts"), "value")
    path, check = str(tmp_path / "out"), str(tmp_path / "check")
    for i, part in enumerate((source.where("value = 3"), source.where("value < 3"))):  # the older rows come later
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ticks.upserting(ticks.ticks(spark, str(tmp_path / "in"), source.schema), path, "series", check).awaitTermination(60)
        assert len(V.versions(spark, path)) == i + 1
    assert {(r["series"], r["value"]) for r in V.read(spark, path).collect()} == {("a", 3), ("b", 2)}
    V.upsert(spark, path, source.where("value = 1"), "series", (check, 1))  # the last micro-batch again
    assert {(r["series"], r["value"]) for r in V.read(spark, path).collect()} == {("a", 3), ("b", 2)}
