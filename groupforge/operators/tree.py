"""The ownership forest: best mother of each company, root, depth and loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupforge.plans.storage import cut

#: Rank of each role, the smallest wins; other roles never make a mother.
RANKS = {"73": 1, "51": 2, "30": 2, "28": 3, "29": 3, "131": 3, "74": 4, "75": 4, "53": 5, "65": 6, "64": 6, "11": 7, "99": 8}
MAX_CHILDREN = 500


def open_links(links: DataFrame) -> DataFrame:
    return links.where(F.col("closed").isNull() & (F.col("parent") != F.col("child")))


def best_mothers(links: DataFrame, max_children: int = MAX_CHILDREN) -> DataFrame:
    """child, mother, role: by rank, then the parent with most open links, then parent and role. Parents above max_children don't count."""
    active = open_links(links).select("parent", "child", "role")
    degree = active.groupBy("parent").agg(F.count("*").alias("n")).where(F.col("n") <= max_children)
    ranks = F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])
    ranked = active.withColumn("rank", ranks[F.col("role")]).where("rank is not null").join(degree, "parent")
    best = ranked.groupBy("child").agg(F.min(F.struct("rank", (-F.col("n")).alias("n"), "parent", "role")).alias("best"))
    return best.select("child", F.col("best.parent").alias("mother"), F.col("best.role").alias("role"))


def jumps(mothers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pointers doubled until all end or run in loops: (node, at, steps) of those that ended, (node, at) of those that run.

    A doubling that ends nothing proves that nothing more will end; from then on the places pointed at are a shrinking set, and one that
    no longer shrinks holds just the members of loops. So the rounds grow with the logarithm of the longest way.
    """
    state = cut(mothers.select(F.col("child").alias("node"), F.col("mother").alias("at"), F.lit(1).cast("long").alias("steps"), F.lit(False).alias("ended")))
    before = None
    while True:
        running = state.where("not ended")
        now = tuple(running.agg(F.count("*"), F.count_distinct("at")).first())
        if now[0] == 0 or now == before:
            return state.where("ended"), running
        before = now
        ahead = state.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"), F.col("ended").alias("over"))
        moving = running.join(ahead, "at", "left")
        moved = moving.select("node", F.coalesce("next", "at").alias("at"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), (F.col("next").isNull() | F.coalesce("over", F.lit(False))).alias("ended"))
        state = cut(state.where("ended").unionByName(moved))


def _loop_lows(mothers: DataFrame, members: DataFrame) -> DataFrame:
    """Smallest node of each loop: (node, low). Once a doubling lowers nothing, each window of the loop has seen its smallest node."""
    ring = mothers.withColumnRenamed("child", "node").join(members, "node", "left_semi")
    state = cut(ring.select("node", F.col("mother").alias("at"), "node").toDF("node", "at", "low"))
    while True:
        ahead = state.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("low").alias("lower"))
        state = cut(state.join(ahead, "at").select("node", F.col("next").alias("at"), F.least("low", "lower").alias("low"), (F.col("lower") < F.col("low")).alias("moved")))
        if state.where("moved").isEmpty():
            return state.select("node", "low")
        state = state.drop("moved")


def loop_members(mothers: DataFrame) -> DataFrame:
    """node: companies that are part of a loop."""
    return jumps(mothers)[1].select(F.col("at").alias("node")).distinct()


def roots(mothers: DataFrame) -> DataFrame:
    """child, root, depth, loop of each company with a mother.

    A loop's root is its smallest company, at depth 0; it and all below it are flagged. Pointers are doubled: nodes that never end run
    into loops; where they point then are loop members; each loop's smallest member loses its mother, and the doubling gives the depths.
    """
    ended, running = jumps(mothers)
    straight = ended.select(F.col("node").alias("child"), F.col("at").alias("root"), F.col("steps").alias("depth"), F.lit(False).alias("loop"))
    if running.isEmpty():
        return straight
    members = running.select(F.col("at").alias("node")).distinct()
    tops = _loop_lows(mothers, members).where("node = low").select(F.col("node").alias("child"))
    inside = mothers.join(running.select(F.col("node").alias("child")), "child", "left_semi")
    opened, _ = jumps(inside.join(tops, "child", "left_anti"))
    below = opened.select(F.col("node").alias("child"), F.col("at").alias("root"), F.col("steps").alias("depth"), F.lit(True).alias("loop"))
    top = tops.select("child", F.col("child").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit(True).alias("loop"))
    return straight.unionByName(below).unionByName(top)


def tree(links: DataFrame, max_children: int = MAX_CHILDREN) -> DataFrame:
    """child, mother, role, root, depth, loop."""
    mothers = cut(best_mothers(links, max_children))
    return mothers.join(roots(mothers), "child")


def opened(mothers: DataFrame) -> DataFrame:
    """child, mother, role without the mother of each loop's smallest company: a forest."""
    tops = roots(mothers).where("loop and depth = 0").select("child")
    return mothers.join(tops, "child", "left_anti")


def sizes(found: DataFrame) -> DataFrame:
    """root, size; a root counts itself unless a loop gave it a row."""
    members = found.select("root", F.col("child").alias("node")).unionByName(found.select("root", F.col("root").alias("node")))
    return members.distinct().groupBy("root").agg(F.count("*").alias("size"))


def root_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """child, before, after: companies whose root differs between two trees; without a row a company is its own root."""
    a, b = before.select("child", F.col("root").alias("before")), after.select("child", F.col("root").alias("after"))
    both = a.join(b, "child", "full_outer").select("child", F.coalesce("before", "child").alias("before"), F.coalesce("after", "child").alias("after"))
    return both.where(~F.col("before").eqNullSafe(F.col("after")))
