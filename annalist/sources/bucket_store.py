"""A bucketed table in the shared folder, changed by copy-on-write.

Rows are hashed by key into a fixed number of buckets. A change writes replacement files for the buckets it touches into
a new folder and then commits a new manifest, which tells for every bucket the folders its rows are in. Readers follow
one manifest, so they see the state before or after a change and nothing in between. A manifest is committed by giving a
finished file its numbered name in one step that fails if the name is taken (a hard link on local and mounted folders,
elsewhere Hadoop's rename without overwriting, which HDFS does atomically): of two writers one fails. Object stores
without such a step need a single writer.

Every folder is a table that Spark knows as bucketed, one file a bucket and task. So a scan of some buckets opens their
files only, and joins and aggregations by bucket find the rows in place: only what changes a table is shuffled.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.session import filesystem

LEAST_BUCKETS = 16


#: Bytes of input, as Spark estimates it, that one bucket should hold at most.
BUCKET_BYTES = 128 << 20


def default_buckets(spark: SparkSession, rows: DataFrame | None = None) -> int:
    """As many as the session's shuffle partitions, and more if the input is so large that a bucket would pass BUCKET_BYTES."""
    least = max(LEAST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    if rows is None:
        return least
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(-(-size // BUCKET_BYTES), 1 << 20))


class ConcurrentChange(RuntimeError):
    """Another writer committed the generation first."""


def _claim(spark: SparkSession, tmp, name: str) -> None:
    """Gives the file `tmp` the name `name`, or raises if that is taken."""
    fs, target = filesystem(spark, name)
    if fs.getUri().getScheme() == "file":
        try:
            os.link(tmp.toUri().getPath(), target.toUri().getPath())
        except FileExistsError:
            raise ConcurrentChange(f"{name} is taken") from None
        return
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(tmp, target, none)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
            raise ConcurrentChange(f"{name} is taken") from None
        raise


_M = 0xFFFFFFFF


def _murmur3(v: int) -> int:
    """Spark's hash of an integer, which tells the file of a bucketed table that holds it."""
    rot = lambda x, r: (x << r | x >> 32 - r) & _M
    k = rot(v * 0xCC9E2D51 & _M, 15) * 0x1B873593 & _M
    h = rot(42 ^ k, 13) * 5 + 0xE6546B64 & _M
    h ^= 4
    h = (h ^ h >> 16) * 0x85EBCA6B & _M
    h = (h ^ h >> 13) * 0xC2B2AE35 & _M
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def bucket_values(buckets: int) -> list[int]:
    """For each of so many files of a bucketed table the smallest number that Spark puts into it."""
    out, found, v = [-1] * buckets, 0, 0
    while found < buckets:
        b = _murmur3(v) % buckets
        if out[b] < 0:
            out[b] = v
            found += 1
        v += 1
    return out


@contextmanager
def in_place(spark: SparkSession) -> Iterator[None]:
    """Joins planned within take tables by their bucket, although they join on more columns than that."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


_FILE = re.compile(r"_(\d{5,})(?:\.|$)")


class BucketStore:
    """`schemas` names the tables kept under one manifest, so that a change of several tables is one commit.

    `buckets` bounds the manifest and the driver's part of a change. The first manifest keeps the number; a store that is
    opened again has that number, whatever the session's partitions, and another number given for it raises. Column
    `bucket` holds one value for each bucket (`bucket_values`).
    """

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, T.StructType], buckets: int | None = None):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas
        kept = self.manifest().get("buckets")
        if kept and buckets and kept != buckets:
            raise ValueError(f"{root} has {kept} buckets, not {buckets}")
        self.buckets = kept or buckets or default_buckets(spark)
        self.values = bucket_values(self.buckets)

    def bucket(self, *keys: str | Column) -> Column:
        cols = [F.col(k) if isinstance(k, str) else k for k in keys]
        h = F.pmod(F.xxhash64(*[F.coalesce(c.cast("string"), F.lit("\0")) for c in cols]), F.lit(self.buckets)).cast("int")
        return F.array(*[F.lit(v) for v in self.values])[h]

    def _names(self) -> list[int]:
        fs, p = filesystem(self.spark, f"{self.root}/manifests")
        if not fs.exists(p):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(p)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("tmp"))

    def manifest(self) -> dict:
        """The last committed state: {"generation": n, "buckets": how many, "tables": {name: {bucket: [generation folder, ...]}}}."""
        names = self._names()
        if not names:
            return {"generation": 0, "tables": {t: {} for t in self.schemas}}
        fs, p = filesystem(self.spark, f"{self.root}/manifests/{names[-1]:08d}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _table(self, table: str, folder: str) -> DataFrame:
        """A folder as a bucketed table of the session's catalogue, which only knows where the files are."""
        name = self._name(folder)
        if not self.spark.catalog.tableExists(name):
            cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self._fields(table))
            self.spark.sql(f"create table {name} ({cols}) using parquet clustered by (bucket) into {self.buckets} buckets location '{self.root}/{folder}'")
        return self.spark.table(name)

    def _name(self, folder: str) -> str:
        return "annalist_" + hashlib.md5(f"{self.root}/{folder}".encode()).hexdigest()

    def _fields(self, table: str) -> T.StructType:
        return T.StructType([*self.schemas[table].fields, T.StructField("bucket", T.IntegerType())])

    def read(self, table: str, buckets: list[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """Rows of a table, of some buckets only if given: one scan per folder, which opens the files of its buckets."""
        of = (manifest or self.manifest())["tables"].get(table, {})
        by: dict[str, list[int]] = defaultdict(list)
        wanted = None if buckets is None else set(buckets)
        for b, folders in of.items():
            if wanted is None or int(b) in wanted:
                for folder in folders:
                    by[folder].append(int(b))
        out = None
        for folder, own in sorted(by.items()):
            part = self._table(table, folder)
            part = part if len(own) == self.buckets else part.filter(F.col("bucket").isin(own))
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], self._fields(table))

    def written(self, table: str, written: tuple[str, list[int]]) -> DataFrame:
        """What `write` has written, committed or not."""
        return self._table(table, written[0])

    def write(self, table: str, rows: DataFrame, in_order: list[str] | None = None, shuffle: bool = True) -> tuple[str, list[int]]:
        """Writes rows (with column bucket) to a folder of their own, each bucket sorted by `in_order`; not visible before `commit`.

        shuffle: False if the rows lie by bucket already. Returns the folder and the buckets in it.
        """
        folder = f"{table}/{uuid.uuid4().hex[:12]}"
        path = f"{self.root}/{folder}"
        rows = rows.select(*[f.name for f in self.schemas[table].fields], "bucket")
        rows = rows.repartition(self.buckets, "bucket") if shuffle else rows
        out = rows.write.format("parquet").bucketBy(self.buckets, "bucket")
        out = out.sortBy(*in_order) if in_order else out
        out.option("path", path).saveAsTable(self._name(folder))
        fs, p = filesystem(self.spark, path)
        numbers = {int(m.group(1)) for x in fs.listStatus(p) if (m := _FILE.search(x.getPath().getName()))}
        return folder, sorted(self.values[b] for b in numbers)

    def commit(self, before: dict, changes: dict[str, tuple[list[tuple[str, list[int]]], list[int]]], **notes: list) -> dict:
        """Per table: (what was written, touched buckets): the touched buckets are replaced, other written ones gain a folder. notes: kept in the manifest."""
        tables = {t: {b: list(f) for b, f in of.items()} for t, of in before["tables"].items()}
        for table, (written, touched) in changes.items():
            for b in touched:
                tables[table].pop(str(b), None)
            for folder, buckets in written:
                for b in buckets:
                    tables[table].setdefault(str(b), []).append(folder)
        after = {"generation": before["generation"] + 1, "buckets": self.buckets, "tables": tables} | notes
        fs, tmp = filesystem(self.spark, f"{self.root}/manifests/tmp-{uuid.uuid4().hex}.json")
        stream = fs.create(tmp, False)
        stream.write(bytearray(json.dumps(after).encode()))
        stream.close()
        try:
            _claim(self.spark, tmp, f"{self.root}/manifests/{after['generation']:08d}.json")
        finally:
            fs.delete(tmp, False)
        return after

    def vacuum(self) -> int:
        """Removes folders that the last manifest doesn't name; returns how many. Only when no older reader is left."""
        kept = {f for of in self.manifest()["tables"].values() for fs_ in of.values() for f in fs_}
        gone = 0
        for t in self.schemas:
            fs, p = filesystem(self.spark, f"{self.root}/{t}")
            if fs.exists(p):
                for x in fs.listStatus(p):
                    folder = f"{t}/{x.getPath().getName()}"
                    if folder not in kept:
                        self.spark.sql(f"drop table if exists {self._name(folder)}")
                        fs.delete(x.getPath(), True)
                        gone += 1
        return gone
