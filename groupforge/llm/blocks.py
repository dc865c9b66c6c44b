"""Connecting the linked members of groups of any size, in blocks of bounded size, without work on all pairs where that is needless.

1. Members are dealt into blocks (`once`), each in one block only, or in two of different deals if one group makes one unit of work;
   all pairs of a block are compared. What comes out is a star for each connected part, and the stars' components label all members.
2. Links that are still unseen lie between members of different components. In each group of more than one block, the members outside
   of the group's most frequent component meet all others (`apart`): in blocks against blocks of that component, and among each other.
   A group that step 1 found to be connected costs nothing here.

So the work is linear in a group of near copies, and grows with the product only for members that stay apart. No pair is skipped
that could join two components, so the components are those of all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, meet


def dealt(rows: DataFrame, keys: list[str], blocks: Column, member: str) -> DataFrame:
    """Adds block, low and high: rows of one (keys, low, high) meet, each pair of a group once; `blocks`: into how many a group is dealt."""
    rows = rows.withColumn("_n", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64(F.lit(3), member), F.col("_n")).cast("int"))
    rows = rows.withColumn("_other", F.explode_outer(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.withColumn("low", F.least("block", "_other")).withColumn("high", F.greatest("block", "_other")).drop("_n", "_other")


def once(rows: DataFrame, key: str, blocks: Column, member: str, deals: int) -> DataFrame:
    """Adds block, low and high: each row in one block of its group, or in one of each of `deals` deals if there is more than one."""
    rows = rows.withColumn("_n", blocks.cast("int")).withColumn("_deal", F.explode(F.sequence(F.lit(0), F.when(F.col("_n") > 1, deals - 1).otherwise(0))))
    block = F.pmod(F.xxhash64("_deal", key, member), F.col("_n")).cast("int")
    unit = block * deals + F.col("_deal")
    return rows.withColumn("block", F.lit(0)).withColumn("low", unit).withColumn("high", unit).drop("_n", "_deal")


def apart(rows: DataFrame, key: str, member: str, size: str, scratch: Scratch, parts: DataFrame) -> DataFrame | None:
    """Adds block, low, high and part to the rows of groups that hold several components, so that members of different ones meet.

    rows: key, member and size (members of a block), of groups of more than one block; parts: node and component. None if no group is left.
    """
    labelled = rows.join(parts.select(F.col("node").alias(member), F.col("component")).hint("merge"), member, "left")
    labelled = scratch.stage(labelled.withColumn("part", F.coalesce("component", F.col(member))).drop("component"), "labelled")
    counts = labelled.groupBy(key, "part").agg(F.count("*").alias("n"), F.max(size).alias("size"))
    main = counts.groupBy(key).agg(F.max(F.struct("n", (-F.col("part")).alias("low"))).alias("top"), F.sum("n").alias("all"), F.max("size").alias("size"))
    main = main.select(key, (-F.col("top.low")).alias("main"), F.col("top.n").alias("inside"), F.col("all"), F.col("size").alias("_size")).where(F.col("inside") < F.col("all"))
    main = scratch.stage(main, "main")
    if main.isEmpty():
        return None
    left = meet(labelled, main, [key], "all", labelled.count())
    left = left.withColumn("minor", F.col("part") != F.col("main"))
    groups, chunks = F.ceil((F.col("all") - F.col("inside")) / F.col("_size")).cast("int"), F.ceil(F.col("inside") / F.col("_size")).cast("int")
    left = left.withColumn("_minors", groups).withColumn("_mains", chunks).drop("all", "inside", "main", "_size")
    own = F.pmod(F.xxhash64(F.lit(5), member), F.when(F.col("minor"), F.col("_minors")).otherwise(F.col("_mains"))).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("minor"), F.col("_mains")).otherwise(F.col("_minors")) - 1))
    # a main block against a minor one: low counts down from -1, so that it is no minor block
    across = left.withColumn("_own", own).withColumn("_other", others).withColumn("block", F.col("minor").cast("int"))
    across = across.withColumn("low", -1 - F.when(F.col("minor"), F.col("_other")).otherwise(F.col("_own"))).withColumn("high", F.when(F.col("minor"), F.col("_own")).otherwise(F.col("_other")))
    among = dealt(left.where("minor"), [key], F.col("_minors"), member)
    keep = [*rows.columns, "block", "low", "high", "part"]
    return across.select(*keep).unionByName(among.select(*keep))


def joined_up(scratch: Scratch, stars: DataFrame, again) -> DataFrame:
    """node, component from the stars (a, b) of step 1, and then of step 2: again(parts) gives its stars, or None."""
    parts = components(scratch, stars)
    more = again(parts)
    if more is None:
        return parts
    edges = parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more.select("a", "b"))
    return components(scratch, edges)


def gathered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of one unit next to each other in one partition."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def whole_units(batches, keys: int, least_rows: int, least_bytes: int = 8 << 20):
    """Joins Arrow batches so that each one given holds whole units (runs of equal first `keys` columns), in sorted order.

    It goes on once so many rows or bytes are held and a unit has ended, so it holds at most that, a unit and a batch.
    """
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for big in batches:
        for at in range(0, big.num_rows, 1000):
            b = big.slice(at, 1000)
            held.append(b)
            rows, size = rows + b.num_rows, size + b.nbytes
            if rows < least_rows and size < least_bytes:
                continue
            t = pa.Table.from_batches(held)
            ids = unit_ids(t, keys)
            cut = int(np.searchsorted(ids, ids[-1]))
            if cut:
                yield t.slice(0, cut).combine_chunks(), ids[:cut]
                t = t.slice(cut)
            held, rows, size = t.combine_chunks().to_batches(), t.num_rows, t.nbytes
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        if t.num_rows:
            yield t, unit_ids(t, keys)


def unit_ids(t: pa.Table, keys: int) -> np.ndarray:
    new = np.zeros(t.num_rows, dtype=bool)
    for k in range(keys):
        c = t.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


class Merge:
    """Connected parts of the rows of one batch: parent pointers, with labels that follow after each step."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.label = np.arange(n)
        self.moved = False

    def start(self, units: np.ndarray, part: np.ndarray) -> None:
        """Rows of one unit with one part begin connected."""
        order = np.lexsort((part, units))
        first = np.ones(len(order), dtype=bool)
        first[1:] = (units[order][1:] != units[order][:-1]) | (part[order][1:] != part[order][:-1])
        heads = np.minimum.reduceat(order, np.flatnonzero(first)) if len(order) else order
        self.label = np.empty(len(order), dtype=np.int64)
        self.label[order] = np.repeat(heads, np.diff([*np.flatnonzero(first), len(order)]))
        self.parent = self.label.tolist()

    def root(self, a: int) -> int:
        p = self.parent
        while p[a] != a:
            p[a] = p[p[a]]
            a = p[a]
        return a

    def union(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.moved = True

    def settle(self) -> None:
        if self.moved:
            label = np.array(self.parent)
            while (label[label] != label).any():
                label = label[label]
            self.label, self.moved = label, False


def connect(units: np.ndarray, crossing: np.ndarray, block: np.ndarray, size: np.ndarray, signature: np.ndarray, least: list[tuple[int, int]], percent: int, verify=None, part: np.ndarray | None = None) -> np.ndarray:
    """Label of each row: rows of a unit get one label if links join them.

    Pairs at growing distance in the sorted batch, all units at once. A pair is dropped if a path joins it already, if its sizes
    rule the similarity out, or as soon as its equal signature bytes fall under `least` ((bytes seen, least equal) in order).
    crossing: rows of units made of two different blocks, where pairs within a block meet elsewhere. part: labels that are known to be
    connected already.
    """
    merge = Merge(len(units))
    if part is not None:
        merge.start(units, part)
    longest = int(np.bincount(units).max()) if len(units) else 0
    for d in range(1, longest):
        i = np.flatnonzero(units[:-d] == units[d:])
        j = i + d
        keep = merge.label[i] != merge.label[j]
        keep &= ~(crossing[i] & (block[i] == block[j]))
        keep &= 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
        i, j = i[keep], j[keep]
        equal, seen = np.zeros(len(i), dtype=np.int64), 0
        for upto, need in least:
            if not len(i):
                break
            equal += (signature[i, seen:upto] == signature[j, seen:upto]).sum(axis=1)
            keep = equal >= need
            i, j, equal, seen = i[keep], j[keep], equal[keep], upto
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if merge.root(a) != merge.root(b) and (verify is None or verify(a, b)):
                merge.union(a, b)
        merge.settle()
    return merge.label
