"""What the training-data operators share: scratch tables, joins of uneven groups, graph components, bounded caches."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groupforge.plans.storage import shared_folder, ship  # noqa: F401  (ship is for the operators)

#: White space of the contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_dir(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/groupforge"


class Scratch:
    """Tables written once and read again, so that lineage ends there and lost executors cost one table at most.

    A result reads some of them when it runs, so an operator drops what it is done with, and `clear_scratch` the rest once results are written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self._staged: dict[int, tuple[DataFrame, str]] = {}

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> str:
        path = self.path(name)
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return path

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = self.write(df, name)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._staged[id(out)] = (out, path)
        return out

    def drop(self, *tables: str | DataFrame) -> None:
        """Deletes tables, by path or as stage() gave them."""
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else self._staged.pop(id(t))[1])
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: A row's number, stored in a written table: two scans of the same files may number rows differently, as splits follow the live cores.
ROW = "__groupforge_row"


def row_number(docs: DataFrame) -> Column:
    """The stored number where docs has one; else a number of this scan alone, to be written before it is met with anything."""
    return F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()


def numbered(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """docs with a stored row number, written once, so that later scans give each row the same one."""
    return docs if ROW in docs.columns else scratch.stage(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def clear_scratch(spark: SparkSession) -> None:
    """Deletes every scratch table; results that still read one must have been written before."""
    Scratch(spark, "clear").drop(scratch_dir(spark))


#: At most so many groups can each hold more than 1 / UNEVEN of all rows; their side of a join is broadcast.
UNEVEN = 4096


def meet(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """rows (a written table) joined with groups (one row each), where a group may hold any part of the rows.

    size: the column of groups with the number of a group's rows, or more; total: the number of all rows, or more. Groups of more than
    total / UNEVEN rows are few at any size of the data, so they are broadcast and their rows stay where they are. Of all other groups
    none is larger than one of UNEVEN even shares, so they are met by a shuffle. Every row takes one of the two ways. how: inner or left.
    """
    large, more = F.col(size) > total / UNEVEN, [c for c in groups.columns if c not in keys]
    own = [c for c in rows.columns if c not in keys]
    marked = rows.join(F.broadcast(groups.where(large)), keys, "left")
    # all columns are tested, so that both ways broadcast the same table
    met = F.col(size).isNotNull()
    none = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in more])
    hot = marked.where(met).select(*keys, *own, *more)
    cold = marked.where(none).select(*keys, *own).join(groups.where(~large).hint("merge"), keys, how)
    return hot.unionByName(cold.select(*keys, *own, *more))


def by_row(rows: DataFrame, marks: DataFrame, key: str = ROW, how: str = "inner") -> DataFrame:
    """rows joined with marks by a key that is unique in marks: always a shuffle, with the marks of a partition in a hash table."""
    return rows.join(marks.hint("shuffle_hash"), key, how)


def slices(batches, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches (which Spark bounds by bytes) in parts of few rows, as each becomes Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def file_bytes(spark: SparkSession, path: str) -> bytes:
    """A small parameter file (a vocabulary), read on the driver by whichever store holds it."""
    if "://" in path:
        row = spark.read.format("binaryFile").load(path).select("content").first()
        return bytes(row[0])
    with open(path, "rb") as f:
        return f.read()


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


class Recent(dict):
    """Key to value with at most `limit` keys; `make` gives what is missing. Long keys are not kept.

    When full, the older half goes; keys in use come back with their next miss.
    """

    __slots__ = ("limit", "make")

    def __init__(self, make, limit: int = 300_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                for old in list(islice(self, (self.limit + 1) // 2)):
                    del self[old]
            self[key] = value
        return value


def ranked(distinct: DataFrame, keys: list[str], name: str, most: int) -> DataFrame:
    """Adds `name`: 1, 2, ... in the order of (hash of keys, keys), without a global sort in one task.

    Rows are sorted within ranges of the hash, about 2**18 in each; a range's start is the sum of the counts before it (a window over
    the ranges, one row each). Distinct keys spread evenly over the ranges. most: a number of rows that distinct doesn't exceed.
    """
    from pyspark.sql import Window as W

    bits = max(8, (most >> 18).bit_length())
    keyed = distinct.withColumn("_h", F.xxhash64(*keys)).withColumn("_range", F.shiftright("_h", 64 - bits))
    starts = keyed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    starts = starts.select("_range", F.coalesce(before, F.lit(0)).cast("long").alias("_start"))
    place = F.row_number().over(W.partitionBy("_range").orderBy("_h", *keys))
    return keyed.withColumn("_place", place).join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_place")).drop("_h", "_range", "_place", "_start")


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that these links reach) of each node but the smallest ones themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, x, y = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        left = low != high
        if not left.any():
            break
        x, y = x[left], y[left]
        np.minimum.at(label, high[left], low[left])
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(label)))
    return nodes[moved], nodes[label[moved]]


#: Links that a task contracts at a time.
CONTRACTED = 1 << 18


def _contract(links: DataFrame, whole: bool) -> DataFrame:
    """u, v of the links (u, v) of each task, contracted slice by slice, so that a node has one row a slice. whole: the links come sorted
    by u, and all links of a u go into one slice."""

    def run(batches):
        held, rows = [], 0
        for b in batches:
            held.append([b.column(k).to_numpy() for k in (0, 1)])
            rows += b.num_rows
            if rows < CONTRACTED:
                continue
            u, v = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(u, u[-1])) if whole else rows
            if cut:
                yield batch(u[:cut], v[:cut])
            held, rows = [[u[cut:], v[cut:]]], rows - cut
        if rows:
            yield batch(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def batch(u, v):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in contracted(u, v)], ["u", "v"])

    return links.mapInArrow(run, "u long, v long")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a, b), both long; component: the smallest node that links reach.

    Links (u, v) point to the smaller node. A round is a large star (each v gives way to its own smallest v) and a small star (all v of a u
    meet), as of Kiveris et al. 2014, until every u has one v and no v is a u; the number of rounds grows with the logarithm of the longest
    path. A round shuffles three times: its nodes, its links by v, its links by u. In the last the links of a task are contracted as a
    whole, so a u has at most one row from each slice of a task, and no task holds a hub's links; those by v are met as uneven groups.
    """
    ship(scratch.spark)
    start = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
    links = scratch.stage(_contract(_contract(start, False).repartition("u").sortWithinPartitions("u"), True), "links")
    while True:
        ends = links.select(F.col("u").alias("node"), F.lit(1).alias("own"), "v").unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("own"), F.lit(None).cast("long").alias("v")))
        nodes = scratch.stage(ends.groupBy("node").agg(F.sum("own").alias("own"), F.min("v").alias("m"), F.count("*").alias("n")), "nodes")
        passing = (F.col("own") > 0) & (F.col("n") > F.col("own"))
        total, open_ = nodes.agg(F.sum("own"), F.count_if((F.col("own") > 1) | passing)).first()
        if not open_:
            scratch.drop(links)
            return nodes.select("node", F.coalesce("m", "node").alias("component"))
        ups = nodes.where(passing).select(F.col("node").alias("v"), "m", (F.col("n") - F.col("own")).alias("n"))
        jumped = meet(links, ups, ["v"], "n", total, "left").select("u", F.coalesce("m", "v").alias("v"))
        after = scratch.stage(_contract(jumped.repartition("u").sortWithinPartitions("u"), True), "links")
        scratch.drop(links, nodes)
        links = after
