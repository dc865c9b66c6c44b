"""Reachability along links: closures, descent with levels, ascent, sizes of nested groups, nearest ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupforge.operators.tree import jumps, loop_members, roots
from groupforge.plans.storage import cut


def descent(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """start, node, level (the smallest) of all that edges (parent, child) reach from seeds (start, node); level 0: the seeds.

    A frontier loop: only nodes that are new go on, so loops end and no path is walked twice. The edges are written once, dealt by parent,
    however they were made. The result is one table and not a union of levels, into which joins and filters on it would be copied.
    """
    edges = cut(edges.select(F.col("parent").alias("node"), F.col("child").alias("next")).repartition("node"))
    seen = cut(seeds.select("start", "node").distinct().withColumn("level", F.lit(0)))
    frontier, level = seen, 0
    while max_depth is None or level < max_depth:
        level += 1
        ahead = frontier.join(edges, "node")
        ahead = ahead.select("start", F.col("next").alias("node")).distinct().join(seen.select("start", "node"), ["start", "node"], "left_anti")
        frontier = cut(ahead.withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if level % 8 == 0:
            seen = cut(seen)
    return cut(seen) if level > 1 else seen


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """start, node: what edges reach from the seeds, which are part of it."""
    return descent(edges, seeds).select("start", "node")


def ascent(parents: DataFrame) -> DataFrame:
    """node, top, steps: the topmost node above each (node, parent), itself where it has no parent. What runs in a loop has no top.

    Pointers are doubled, so the rounds grow with the logarithm of the longest way up.
    """
    ended, running = jumps(parents.where("parent is not null").select(F.col("node").alias("child"), F.col("parent").alias("mother")))
    tops = parents.where("parent is null").select("node", F.col("node").alias("top"), F.lit(0).cast("long").alias("steps"))
    out = tops.unionByName(ended.select("node", F.col("at").alias("top"), "steps"))
    return out.unionByName(running.select("node", F.lit(None).cast("string").alias("top"), F.lit(None).cast("long").alias("steps")))


def nested_sizes(parents: DataFrame, sizes: DataFrame) -> DataFrame:
    """node, size: a group's own size and those of all groups nested in it, each counted once. parents: node (once), parent.

    Each node holds the sum of what lies less than 2^k levels below it and points 2^k levels up. A round adds its sum to the node it points
    at and doubles the pointer, so no list of ancestors is made and the rounds grow with the logarithm of the depth. Loops are opened at
    their smallest node first; all nodes of a loop hold the same groups, so they get that node's sum.
    """
    edges = cut(parents.where("parent is not null").select(F.col("node").alias("child"), F.col("parent").alias("mother")))
    loops = cut(roots(edges).where("loop"))
    tops = loops.where("depth = 0").select(F.col("child").alias("node"), F.lit(True).alias("is_top"))
    own = sizes.groupBy("node").agg(F.sum("size").cast("long").alias("size"))
    state = parents.select("node", "parent").join(tops, "node", "left").join(own, "node", "left")
    state = cut(state.select("node", F.when(F.col("is_top").isNull(), F.col("parent")).alias("at"), F.coalesce("size", F.lit(0)).alias("size")))
    while not state.where("at is not null").isEmpty():
        gained = state.where("at is not null").groupBy(F.col("at").alias("node")).agg(F.sum("size").alias("more"))
        ahead = state.select(F.col("node").alias("at"), F.col("at").alias("next"))
        moved = state.where("at is not null").join(ahead, "at", "left").select("node", F.col("next").alias("at"), "size").unionByName(state.where("at is null"))
        state = cut(moved.join(gained, "node", "left").select("node", "at", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
    if loops.isEmpty():
        return state.select("node", "size")
    ring = loop_members(edges).join(loops.select(F.col("child").alias("node"), "root"), "node")
    whole = ring.join(state.select(F.col("node").alias("root"), F.col("size").alias("whole")), "root").select("node", "whole")
    return state.join(whole, "node", "left").select("node", F.coalesce("whole", "size").alias("size"))


def nearest(parents: DataFrame, good: DataFrame) -> DataFrame:
    """node, found: the node itself if good, else the nearest good ancestor, or null; parents is (node, parent).

    Good nodes lose their parents; the nearest good ancestor is then the top of what is left, found by doubling.
    """
    good = cut(good.select(F.col("node").alias("top")).distinct().withColumn("is_good", F.lit(True)))
    met = parents.join(good.withColumnRenamed("top", "node"), "node", "left")
    tops = ascent(cut(met.select("node", F.when(F.col("is_good").isNull(), F.col("parent")).alias("parent"))))
    return tops.join(good, "top", "left").select("node", F.when(F.col("is_good"), F.col("top")).alias("found"))
