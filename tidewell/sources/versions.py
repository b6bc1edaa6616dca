"""Tables of versions: keyed upserts that a crash can't tear, readers bound to a version, batches that count once.

A table's folder holds data folders, which nothing ever changes, and manifests _versions/<number>.json. A manifest names the schema, the key, the
number of buckets, the folder of each bucket's rows, and for each writer the last batch that went in. Rows lie in buckets by the hash of their
key: an upsert reads and writes only the buckets that its keys fall into, the others are named again.

A commit publishes a manifest under the next number, if no one has: a rename that fails where the name is taken (a hard link on local disks). The
loser of a race merges its rows into the winner's version and tries again. Whatever stops a writer, readers see the version before or the one after; what
it left behind is named by no manifest, and vacuum() deletes it. A writer's batch that has gone in is not applied again, so a stream
may repeat its last micro-batch after a restart.

Defined cases: rows with a null key are one key; of several new rows with one key an arbitrary one stands (make keys distinct first); a table without
rows has its schema; a table that doesn't exist is one without versions: reading it raises.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS, ATTEMPTS = 16, 20


class Taken(Exception):
    """Another writer has published this version."""


def _reached(step: str) -> None:
    """Called between the steps of an upsert; tests stop here."""


class Folder:
    """Hadoop's file system at a table's path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.jvm.org.apache.hadoop.fs.Path(path).getFileSystem(self.conf)
        self.root = self.fs.makeQualified(self.jvm.org.apache.hadoop.fs.Path(path)).toString().rstrip("/")

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def names(self, name: str) -> list[tuple[str, float]]:
        """Entries and when each was changed, in seconds."""
        if not self.fs.exists(self.at(name)):
            return []
        return [(x.getPath().getName(), x.getModificationTime() / 1000) for x in self.fs.listStatus(self.at(name))]

    def text(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        stream = self.fs.create(self.at(name), False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def publish(self, staged: str, name: str) -> None:
        """Give a staged file its name, if that is free."""
        if urlparse(self.root).scheme == "file":
            local = urlparse(self.root).path
            try:
                os.link(f"{local}/{staged}", f"{local}/{name}")
            except FileExistsError:
                raise Taken(name) from None
            return
        fs = self.jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(self.at(name).toUri(), self.conf)
        try:
            context.rename(self.at(staged), self.at(name), self._no_options())
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                raise Taken(name) from None
            raise

    def _no_options(self):
        from py4j.java_gateway import JavaClass

        gateway = self.jvm._gateway_client
        kind = JavaClass("org.apache.hadoop.fs.Options$Rename", gateway)
        return self.jvm.java.lang.reflect.Array.newInstance(kind._java_lang_class, 0)

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def _name(version: int) -> str:
    return f"_versions/{version:020d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the published versions, in order."""
    return sorted(int(n[:-5]) for n, _ in Folder(spark, path).names("_versions") if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """What a version (the last one) names; None where there is none."""
    known = versions(spark, path)
    if version is None and not known:
        return None
    if version is not None and version not in known:
        raise ValueError(f"{path} has no version {version}")
    return json.loads(Folder(spark, path).text(_name(known[-1] if version is None else version)))


def _rows(spark: SparkSession, path: str, found: dict, buckets: list[str] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(found["schema"])
    folders = sorted(f for b, f in found["folders"].items() if buckets is None or b in buckets)
    root = Folder(spark, path).root
    return spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version (the last one); what is published later doesn't change them."""
    found = manifest(spark, path, version)
    if found is None:
        raise ValueError(f"{path} has no version")
    return _rows(spark, path, found)


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str | list[str], batch: tuple[str, int] | None = None, buckets: int = BUCKETS) -> int:
    """Rows of new replace those with their key; the version that holds them.

    batch: a writer's name and the number of its batch; one that is no later than the writer's last changes nothing. buckets: of a new table.
    """
    keys, folder = [key] if isinstance(key, str) else key, Folder(spark, path)
    for _ in range(ATTEMPTS):
        old = manifest(spark, path)
        if old and batch and old["batches"].get(batch[0], -1) >= batch[1]:
            return old["version"]
        schema, n = (T.StructType.fromJson(old["schema"]), old["buckets"]) if old else (new.schema, buckets)
        bucket = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int").alias("_bucket")
        fresh = new.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]).dropDuplicates(keys)
        touched = [str(r[0]) for r in fresh.select(bucket).distinct().collect()]  # numbers under n
        if old:
            same = F.lit(True)
            for k in keys:
                same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"f.{k}"))
            kept = _rows(spark, path, old, touched).alias("o").join(fresh.alias("f"), same, "left_anti")
            fresh = kept.unionByName(fresh)
        data = f"data-{uuid.uuid4().hex}"
        _reached("before data")
        fresh.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{folder.root}/{data}")
        _reached("data written")
        made = {n[len("_bucket=") :] for n, _ in folder.names(data) if n.startswith("_bucket=")}
        folders = {b: f for b, f in (old["folders"] if old else {}).items() if b not in touched} | {b: f"{data}/_bucket={b}" for b in made}
        number = old["version"] + 1 if old else 0
        batches = (old["batches"] if old else {}) | ({batch[0]: batch[1]} if batch else {})
        told = {"version": number, "schema": schema.jsonValue(), "key": keys, "buckets": n, "folders": folders, "batches": batches}
        staged = f"_versions/.{uuid.uuid4().hex}"
        folder.put(staged, json.dumps(told))
        _reached("manifest staged")
        try:
            folder.publish(staged, _name(number))
        except Taken:
            folder.delete(data)
            continue
        finally:
            folder.delete(staged)
        _reached("published")
        return number
    raise RuntimeError(f"{path}: {ATTEMPTS} other writers were first")


def vacuum(spark: SparkSession, path: str, keep: int = 2, older_than: float = 3600.0) -> list[str]:
    """Delete all but the last keep versions, and data that none of these names and that hasn't changed for so many seconds; what was deleted."""
    folder, known, now, gone = Folder(spark, path), versions(spark, path), time.time(), []
    kept = known[-keep:]
    for v in known[:-keep]:
        gone.append(_name(v))
    used = {f.split("/")[0] for v in kept for f in manifest(spark, path, v)["folders"].values()}
    gone += [n for n, changed in folder.names("") if n.startswith("data-") and n not in used and now - changed >= older_than]
    gone += [f"_versions/{n}" for n, changed in folder.names("_versions") if n.startswith(".") and not n.endswith(".crc") and now - changed >= older_than]
    for n in gone:
        folder.delete(n)
    return gone
