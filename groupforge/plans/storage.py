"""Cutting lineage in the shared folder, and tables whose commits are all or nothing."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one on a single machine, and an error on a cluster."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="groupforge-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, from a checkpoint that every executor can read."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


LEAST_SHUFFLED = 256 * 1024


@contextmanager
def shuffled(spark: SparkSession) -> Iterator[None]:
    """Within it joins broadcast no table of more than LEAST_SHUFFLED bytes for its size, so what a join sends to the driver is bounded and
    doesn't grow with the data. A lower setting stays; hints still hold."""
    size, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    jvm = spark._jsparkSession.sessionState().conf()
    least = min(LEAST_SHUFFLED, jvm.autoBroadcastJoinThreshold())
    before = {n: spark.conf.get(n, None) for n in (size, adaptive)}
    try:
        for n in before:
            spark.conf.set(n, str(least))
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What make gives, worked out within shuffled and written: whoever reads it runs none of its joins, so none is broadcast then either."""
    with shuffled(spark):
        return cut(make())


@contextmanager
def ordered_buckets(spark: SparkSession) -> Iterator[None]:
    """Within it, plans may rely on the order of buckets that are one sorted file each (Spark checks the number of files)."""
    settings = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def compact(spark: SparkSession, pattern: str, path: str, files: int) -> int:
    """Writes what many part files hold as a few, and gives the number of rows."""
    spark.read.parquet(pattern).repartition(files).write.parquet(path)
    return spark.read.parquet(path).count()


def carried_over(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of an earlier store's table in the columns of the new one, by name; columns it lacked are null, others are left behind."""
    return old.select(*[F.col(c).cast(new.schema[c].dataType).alias(c) if c in old.columns else F.lit(None).cast(new.schema[c].dataType).alias(c) for c in new.columns])


class Shelf:
    """Tables of one run, each written once in the shared folder and read again: lineage ends there, and plans know their sizes."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.held = spark, f"{shared_folder(spark)}/groupforge/{name}-{uuid.uuid4().hex[:12]}", []

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.held):04d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((path, out))
        return out

    def together(self, *tables: DataFrame) -> DataFrame:
        """What several of its tables (of the same columns) hold, as one scan; nothing is written."""
        paths = [path for t in tables for path, table in self.held if table is t]
        return self.spark.read.schema(tables[0].schema).parquet(*paths)

    def close(self, *but: DataFrame) -> None:
        """Deletes all tables but those that a result still reads."""
        for path, table in self.held:
            if not any(table is b for b in but):
                deleted(self.spark, path)
        self.held = []


def deleted(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Keyed:
    """A table written once in hash buckets of a key; a lookup reads only the buckets that its keys fall into.

    What reaches the driver are numbers of buckets, so at most `buckets` of them. Rows of one bucket are spread over PARTS tasks.
    """

    PARTS = 4

    def __init__(self, df: DataFrame, key: str, buckets: int = 16):
        self.spark, self.key, self.buckets = df.sparkSession, key, buckets
        self.path = f"{shared_folder(self.spark)}/groupforge/keyed-{uuid.uuid4().hex[:12]}"
        dealt = df.withColumn("_b", self._bucket()).repartition("_b", F.pmod(F.xxhash64(*df.columns), F.lit(self.PARTS)))
        dealt.write.partitionBy("_b").parquet(self.path)
        self.schema = T.StructType([*[f for f in df.schema.fields], T.StructField("_b", T.IntegerType())])

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).drop("_b")

    def of(self, keys: DataFrame) -> DataFrame:
        """The rows of the buckets of keys (a column of the key's name); rows of other keys may be among them, so join."""
        wanted = sorted(r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect())
        return self.spark.read.schema(self.schema).parquet(self.path).where(F.col("_b").isin(wanted)).drop("_b")

    def drop(self) -> None:
        deleted(self.spark, self.path)


class Sorted:
    """A table written once in sorted hash buckets of a key, one file each: joins by that key read it in order, and neither shuffle nor sort it
    (within ordered_buckets). There are as many buckets as shuffle partitions. dealt: df is dealt by the key into as many already."""

    def __init__(self, df: DataFrame, key: str, dealt: bool = False):
        self.spark, self.key, self.buckets = df.sparkSession, key, buckets_here(df.sparkSession)
        name = f"groupforge_sorted_{uuid.uuid4().hex}"
        self.table, self.path = name, f"{shared_folder(self.spark)}/groupforge/{name}"
        rows = (df if dealt else df.repartition(self.buckets, key)).sortWithinPartitions(key)
        rows.write.bucketBy(self.buckets, key).sortBy(key).option("path", self.path).saveAsTable(name)

    def all(self) -> DataFrame:
        return self.spark.table(self.table)

    def of(self, keys: DataFrame) -> DataFrame:
        """As Keyed.of: rows of other keys are among them, so join."""
        return self.all()

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.table}")
        deleted(self.spark, self.path)


def buckets_here(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, which need not have it installed; once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="groupforge-ship-"), "groupforge_code.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, files in sorted(os.walk(package)):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


class Conflict(RuntimeError):
    """Another writer committed first; nothing of this commit is seen."""


class Release:
    """Tables that change together. A commit is one small file that names a Parquet folder for each table, so readers see all of it or nothing.

    Rows go to a folder of their own before the commit's file is created; that is only created where it is absent, so of two writers that
    start from the same commit one wins and the other gets a Conflict. (As safe as the file system's create is; an object store needs one
    with conditional writes.) A commit's file that isn't whole is not seen by readers, and writers refuse to pass it, since its writer may
    still be at work; delete it once that writer is known to be gone. Folders of lost commits stay until they are deleted.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        at = self._path(self.root)
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted((int(n[7:]) for n in names if n.startswith("commit-")), reverse=True)

    def _manifest(self, n: int) -> dict[str, str] | None:
        stream = self._fs.open(self._path(f"{self.root}/commit-{n}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def _last(self) -> tuple[int, dict[str, str]]:
        for n in self._numbers():
            if (found := self._manifest(n)) is not None:
                return n, found
        return 0, {}

    def newest(self) -> int:
        """The number of the last whole commit; 0 where there is none."""
        return self._last()[0]

    def read(self, name: str) -> DataFrame | None:
        folder = self._last()[1].get(name)
        return None if folder is None else self.spark.read.parquet(f"{self.root}/{folder}")

    def commit(self, tables: dict[str, DataFrame], after: int) -> int:
        """Writes tables as the commit that follows number `after`, the one they derive from; other tables stay as they are there.

        after=0: there must be no commit yet.
        """
        known = {} if after == 0 else self._manifest(after)
        folders = {}
        for name, df in tables.items():
            folders[name] = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{folders[name]}")
        if self._numbers()[:1] not in ([], [after]) or (after and known is None):
            raise Conflict(f"{self.root}: another commit follows number {after}")
        try:
            out = self._fs.create(self._path(f"{self.root}/commit-{after + 1}"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"{self.root}: another commit follows number {after}") from None
            raise
        out.write(bytearray(json.dumps(known | folders).encode()))
        out.close()
        return after + 1


class Versions:
    """One table as a Release: a write is all or nothing, and of two writers that start from the same version one gets a Conflict."""

    def __init__(self, spark: SparkSession, root: str):
        self.release = Release(spark, root)

    def newest(self) -> int | None:
        return self.release.newest() or None

    def read(self) -> DataFrame | None:
        return self.release.read("rows")

    def write(self, df: DataFrame) -> int:
        return self.release.commit({"rows": df}, self.release.newest())
