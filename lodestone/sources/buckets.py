"""Tables of rows by key that change a little at a time: rows are dealt to buckets by a hash of the key, a change adds a folder to
the buckets it touches, and reading joins a bucket's folders again. What is not touched is neither read nor written.

A version is one small file that names every bucket's folders; it comes into being whole, or not at all where another writer
was first (put_if_absent). That writer's version is then read, and the change is put on top of it: changes by key do not depend
on what was there. A change that does (`upto`), and the joining of folders, fail with Conflict where their buckets have changed.
A run that dies leaves folders that no version names."""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, MOST_FOLDERS = 64, 8
#: What a task holds of each file at most, where it writes to all buckets at once.
OPEN_BYTES = 4 << 20


class Conflict(Exception):
    """Another writer has changed what this change rests on."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it is missing."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file whole; False where one of that name is there already. Local files are linked into place, which only one
    writer can; other stores are asked not to overwrite."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    local = fs.makeQualified(p).toUri()
    if local.getScheme() == "file":
        own = f"{local.getPath()}.{uuid.uuid4().hex}"
        with open(own, "x", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(own, local.getPath())
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
        return True
    try:
        out = fs.create(p, False)
    except Exception as e:
        if "AlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


@contextlib.contextmanager
def _open_files(spark: SparkSession, most: int) -> Iterator[None]:
    """Writers keep up to `most` files open at once, in place of sorting their rows by file."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(most, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Log:
    """Numbered entries in a folder, each put once."""

    def __init__(self, spark: SparkSession, where: str):
        self.spark, self.where = spark, where

    def latest(self) -> tuple[int, dict]:
        """(0, {}) before the first."""
        there = [x for x in children(self.spark, self.where) if x.endswith(".json") and x[:-5].isdigit()]
        return (int(there[-1][:-5]), json.loads(read_text(self.spark, f"{self.where}/{there[-1]}"))) if there else (0, {})

    def put(self, version: int, entry: dict) -> bool:
        return put_if_absent(self.spark, f"{self.where}/{version:012d}.json", json.dumps(entry))


class Buckets:
    """A table of unique keys. Rows with a null among the keys are one key like any other."""

    def __init__(self, spark: SparkSession, where: str, keys: list[str], schema: str, buckets: int = BUCKETS, most_folders: int | None = None):
        self.spark, self.where, self.keys, self.schema, self.buckets = spark, where.rstrip("/"), keys, schema, buckets
        self.most_folders = most_folders or MOST_FOLDERS
        self.log = Log(spark, f"{self.where}/log")

    def version(self) -> int:
        return self.log.latest()[0]

    def notes(self) -> dict:
        """What the last change said of itself."""
        return self.log.latest()[1].get("notes", {})

    def read(self, touched: list[int] | None = None, columns: list[str] | None = None, together: str | None = None) -> DataFrame:
        """The rows as of the latest version; of the buckets `touched` only, where given. Of `columns` only: others are neither read nor
        shuffled, which a selection afterwards does not spare where folders are joined. `together`: one of several keys, by which the
        caller groups: where folders are joined rows are dealt by it at once, and not a second time."""
        return self._read(self.log.latest()[1], touched, columns, together)

    def _read(self, entry: dict, touched: list[int] | None = None, columns: list[str] | None = None, together: str | None = None) -> DataFrame:
        folders = {int(b): f for b, f in entry.get("folders", {}).items() if f and (touched is None or int(b) in touched)}
        every = self.spark.createDataFrame([], self.schema).schema.fields
        names = [f.name for f in every if columns is None or f.name in columns]
        held = [f for f in every if f.name in {*names, *self.keys}]
        own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held) + ", __gone boolean"
        load = lambda fs: self.spark.read.schema(own).parquet(*(f"{self.where}/{f}" for f in fs))
        # a bucket of one folder is read as it is; of the others, the last row of each key counts
        parts = [load(single).filter("not __gone").select(*names)] if (single := [f[0] for f in folders.values() if len(f) == 1]) else []
        several = [f for f in folders.values() if len(f) > 1]
        if several:
            layers = [load(at).withColumn("__at", F.lit(k)) for k in range(max(map(len, several))) if (at := [f[k] for f in several if len(f) > k])]
            union = reduce(DataFrame.unionByName, layers)
            last = (union.repartition(together) if together else union).groupBy(*self.keys).agg(F.max_by(F.struct(*names, "__gone"), "__at").alias("__row"))
            # keys as grouped by, so that how the rows are dealt stays known
            parts.append(last.filter("not __row.__gone").select(*(F.col(n) if n in self.keys else F.col(f"__row.{n}").alias(n) for n in names)))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schema).select(*names)

    def write(self, rows: DataFrame | None, gone: DataFrame | None = None, upto: int | None = None, notes: dict | None = None, whole: bool = False, in_place: bool = False) -> int:
        """Rows replace those of their key, keys of `gone` go; gives the new version. With `upto`, fails with Conflict unless that is
        still the latest version; else whatever others wrote meanwhile stays below. `whole`: the rows are all there are.
        `in_place`: each task writes its rows to all their buckets at once, so that rows are neither shuffled nor sorted; that makes a
        file for each task and bucket, and is for many wide rows of few partitions."""
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema.fields]
        parts = [] if rows is None else [rows.select(*names, F.lit(False).alias("__gone"))]
        if gone is not None:
            empty = {f.name: F.lit(None).cast(f.dataType) for f in self.spark.createDataFrame([], self.schema).schema.fields}
            parts.append(gone.select(*(F.col(n) if n in self.keys else empty[n].alias(n) for n in names), F.lit(True).alias("__gone")))
        folder = f"data/{uuid.uuid4().hex}"
        dealt = reduce(DataFrame.unionByName, parts).withColumn("__bucket", self._bucket())
        if in_place:
            with _open_files(self.spark, self.buckets):
                dealt.write.option("parquet.block.size", OPEN_BYTES).option("compression", "zstd").partitionBy("__bucket").parquet(f"{self.where}/{folder}")
        else:
            # rebalanced, so that a bucket of many rows is written by several tasks
            dealt.hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{self.where}/{folder}")
        touched = {int(x.partition("=")[2]): f"{folder}/{x}" for x in children(self.spark, f"{self.where}/{folder}") if x.startswith("__bucket=")}
        while True:
            at, entry = self.log.latest()
            if upto is not None and at != upto:
                raise Conflict(f"version {at} was written after {upto}")
            folders = {} if whole else dict(entry.get("folders", {}))
            for b, f in touched.items():
                folders[str(b)] = [*folders.get(str(b), []), f]
            if self.log.put(at + 1, {"folders": folders, "notes": notes if notes is not None else entry.get("notes", {})}):
                self._join_folders(at + 1)
                return at + 1

    def _join_folders(self, version: int) -> None:
        """Buckets of more than most_folders folders become one folder, unless other writers change them meanwhile in another way
        than by adding folders."""
        at, entry = self.log.latest()
        old = {b: f for b, f in entry["folders"].items() if len(f) > self.most_folders} if at == version else {}
        if not old:
            return
        folder = f"data/{uuid.uuid4().hex}"
        rows = self._read(entry, [int(b) for b in old]).withColumn("__gone", F.lit(False)).withColumn("__bucket", self._bucket())
        rows.hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{self.where}/{folder}")
        there = set(children(self.spark, f"{self.where}/{folder}"))
        while True:
            at, entry = self.log.latest()
            now = entry["folders"]
            if any(now.get(b, [])[: len(f)] != f for b, f in old.items()):
                return
            joined = {b: [f"{folder}/__bucket={b}"] * (f"__bucket={b}" in there) + now[b][len(f) :] for b, f in old.items()}
            if self.log.put(at + 1, entry | {"folders": now | joined}):
                return

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
