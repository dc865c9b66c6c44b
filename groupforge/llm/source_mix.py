"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of words. Each source gets a target: its weight's share of the whole budget, stopped at
`most` times its size, the excess going to the other sources by weight until none is above. A source takes all its documents
as often as the target holds them whole; the remaining budget is fitted over the counts of documents by exact length: a
proportional part of every length, then longest first, then a bounded-knapsack table for the last words. Where that misses
the budget, a second table does not keep what was taken: up to SWAP_WORDS it holds every sum up to the budget, beyond that
every sum that exchanges of documents make within half of SWAP_WORDS of it. The sum is the best reachable one for budgets
up to SWAP_WORDS, and beyond them where w * (w + 1) for the longest document w is at most half of that (lengths and budgets
divided by the lengths' common divisor). Which documents of a length are taken follows a seeded hash of the id.

Nothing is ordered in one task: the hash is cut into ranges, whole ranges are taken by their counts, and only documents of
the one range that a count cuts are numbered. Sources may be many (hosts, say): they stay in tables, the driver gets a few sums a
round, and a source that holds much of the rows meets its target by broadcast (common.meet). One task fits a source, over its
distinct lengths.

Defined results: a null text has size 0; documents of size 0 are never counted; a very long one is one length. A null source is a
source of its own, last in order. Repeated rows are documents of their own. An empty table gives an empty result. Only the named
columns are read, so others can't clash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROW, Scratch, by_row, documents, meet, numbered, row_number

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST, SEED = 1.5, 2.0, 20
#: Words that the knapsack table fits; what exceeds them is taken longest first.
TABLE_WORDS = 1 << 16
#: Sums that the table of exchanges holds, at five bytes each.
SWAP_WORDS = 1 << 24


def ordered(df: DataFrame, column: str, name: str, scratch: Scratch) -> DataFrame:
    """Adds name: the place of each row, from 0, in the order of a column of distinct strings, sorted in ranges."""
    spread = scratch.stage(df.repartitionByRange(column).sortWithinPartitions(column).withColumn("_at", F.monotonically_increasing_id()), "spread")
    starts = spread.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"))  # one row a partition
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    placed = spread.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(starts), "_part")
    return placed.withColumn(name, F.col("_start") + F.col("_at") % (1 << 33)).drop("_at", "_part", "_start")


def goals_of(sizes: DataFrame, scratch: Scratch, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """key, docs, source_size, target, whole (times that all documents are taken) and rest (words to fit) of each source.

    sizes: key ("" for null, else "s" and the source), docs, words. Each round stops the sources whose share of what is left is above
    `most` times their size. The rounds' sums are of whole and half numbers, so they are the same in any order.
    """
    order = F.when(F.col("key") == "", F.lit("t")).otherwise(F.col("key"))  # after all that begin with s
    placed = ordered(sizes.withColumn("_order", order), "_order", "_place", scratch)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights)).cast("int"))
    rows = scratch.stage(placed.select("key", "docs", F.col("words").alias("source_size"), weight.alias("weight"), (F.col("words") * F.lit(most)).alias("cap")), "weights")
    left = share * float(rows.agg(F.sum("source_size")).first()[0] or 0)
    target, stopped = F.lit(0.0), F.col("source_size") == 0
    while True:
        total = rows.where(~stopped).agg(F.sum("weight")).first()[0]
        if not total:
            break
        aim = F.lit(left) * F.col("weight") / F.lit(total)
        above = ~stopped & (aim > F.col("cap"))
        over = rows.where(above).agg(F.sum("cap")).first()[0]
        if over is None:
            target = F.when(stopped, target).otherwise(aim)
            break
        target = F.when(above, F.col("cap")).otherwise(target)
        stopped, left = stopped | above, left - over
    rows = rows.select("key", "docs", "source_size", target.alias("target"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.bround(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    rest = F.when(F.col("whole") >= most, 0).otherwise(F.greatest(F.lit(0).cast("long"), F.least(rest, "source_size")))
    return scratch.stage(rows.withColumn("whole", whole).withColumn("rest", rest.cast("long")), "goals")


def exchanged(lengths: list[int], counts: list[int], take: list[int], budget: int, swap: int = SWAP_WORDS) -> list[int]:
    """The counts whose words come closest to the budget from below, of all that the table reaches from `take`.

    A closest solution that differs least from `take` differs by at most 2 * w documents (w: the longest length): in an order
    whose partial sums stay within w (Steinitz) none repeats. So w * (w + 1) words either way hold one.
    """
    g = math.gcd(*lengths)
    lengths, budget = [n // g for n in lengths], budget // g
    if budget <= swap:
        take, low, high = [0] * len(take), 0, budget
        goal = budget
    else:
        goal = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
        low, high = -(swap // 2), max(goal, swap // 2)
    # first[s - low]: the step that made the sum s; a step adds or takes away some documents of one length
    first = np.full(high - low + 1, -1, dtype=np.int32)
    made = np.zeros(high - low + 1, dtype=bool)
    made[-low], least, most = True, -low, -low
    steps = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        for sign, free in ((1, counts[i] - take[i]), (-1, take[i])):
            free, part = min(free, (high - low) // lengths[i]), 1
            while free and not made[goal - low]:
                k = min(part, free)
                by = sign * k * lengths[i]
                a, b = max(least, -by, 0), min(most, high - low - by, high - low)
                if a <= b:
                    new = np.flatnonzero(made[a : b + 1] & ~made[a + by : b + by + 1]) + (a + by)
                    if len(new):
                        made[new], first[new] = True, len(steps)
                        least, most = min(least, int(new[0])), max(most, int(new[-1]))
                        steps.append((i, sign * k))
                free -= k
                part *= 2
    at = int(np.flatnonzero(made[: goal - low + 1])[-1])
    take = list(take)
    while first[at] >= 0:
        i, k = steps[first[at]]
        take[i] += k
        at -= k * lengths[i]
    return take


def fit(lengths: list[int], counts: list[int], budget: int, table: int = TABLE_WORDS, swap: int = SWAP_WORDS) -> list[int]:
    """How many documents of each length to take once, so that their words come to the budget or just below."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    take = [c * max(budget, 0) // total for c in counts]
    rest = max(budget, 0) - sum(n * t for n, t in zip(lengths, take, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        if rest <= table:
            break
        n = lengths[i]
        k = min(counts[i] - take[i], (rest - table) // n + 1 if n <= table else rest // n)
        take[i] += k
        rest -= k * n
    # bounded knapsack: bit s of `sums` is set if s words can be made; steps keep the way back
    mask, sums, steps = (1 << (rest + 1)) - 1, 1, []
    for i in order:
        n, free = lengths[i], counts[i] - take[i]
        free = min(free, rest // n)
        part = 1
        while free and not sums >> rest & 1:
            k = min(part, free)
            if (more := (sums | sums << (k * n)) & mask) != sums:
                steps.append((i, k, sums))
                sums = more
            free -= k
            part *= 2
    at = sums.bit_length() - 1
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            take[i] += k
            at -= k * lengths[i]
    if max(budget, 0) - sum(n * t for n, t in zip(lengths, take, strict=True)) >= math.gcd(*lengths):
        take = exchanged(lengths, counts, take, budget, swap)
    return take


def _fit_source(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("size")
    budget = int(frame["rest"].iloc[0])
    taken = fit([int(x) for x in frame["size"]], [int(x) for x in frame["n"]], budget)
    return pd.DataFrame({"key": frame["key"], "size": frame["size"], "extra": np.array(taken, dtype="int64")})


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, range_bits: int | None = None) -> DataFrame:
    """One row per row of docs: row, id, source, size, source_size, target, copies, taken."""
    scratch = Scratch(docs.sparkSession, "mix")
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    key = F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    base = scratch.stage(docs.select(row_number(docs).alias("row"), F.col(id_col).alias("id"), key.alias("key"), size.alias("size")), "sizes")
    total = base.count()
    bits = range_bits or max(10, (total >> 18).bit_length())
    goals = goals_of(base.groupBy("key").agg(F.count("*").alias("docs"), F.sum("size").alias("words")), scratch, weights, share, most)
    base = base.withColumn("_r", F.xxhash64(F.lit(seed), "id")).withColumn("_range", F.shiftright("_r", 64 - bits))

    cells = scratch.stage(base.where("size > 0").groupBy("key", "size", "_range").agg(F.count("*").alias("n")), "cells")
    lengths = cells.groupBy("key", "size").agg(F.sum("n").alias("n")).join(goals.where("rest > 0").select("key", "rest").hint("merge"), "key")
    extra = lengths.groupBy("key").applyInPandas(_fit_source, "key string, size long, extra long").where("extra > 0")
    extra = scratch.stage(extra, "extra")

    before = F.coalesce(F.sum("n").over(W.partitionBy("key", "size").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    quotas = cells.withColumn("_before", before).join(extra.hint("merge"), ["key", "size"]).where("_before < extra")
    quotas = quotas.select("key", "size", "_range", F.least("n", F.col("extra") - F.col("_before")).alias("quota"), "n")
    met = scratch.stage(base.join(quotas.hint("merge"), ["key", "size", "_range"], "left"), "met")
    whole = met.where("quota is null or quota = n").select("row", "id", "key", "size", F.when(F.col("quota").isNull(), 0).otherwise(1).alias("more"))
    place = F.row_number().over(W.partitionBy("key", "size", "_range").orderBy("_r", "id", "row"))
    cut = met.where("quota < n").select("row", "id", "key", "size", (place <= F.col("quota")).cast("int").alias("more"))
    picked = scratch.stage(whole.unionByName(cut), "picked")
    scratch.drop(cells, extra, met)
    copies = F.col("whole") + F.col("more")
    out = meet(picked, goals, ["key"], "docs", total)
    source = F.when(F.col("key") == "", F.lit(None)).otherwise(F.expr("substring(key, 2)"))
    return out.select("row", "id", source.alias("source"), "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **more) -> DataFrame:
    """The mixture itself: rows of docs, as often as they are taken. Rows without words cost nothing and stay once."""
    scratch, columns = Scratch(docs.sparkSession, "mix-copies"), docs.columns
    docs = numbered(scratch, docs)
    found = mixture(docs, id_col, text_col, source_col, **more)
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("copies").cast("int")).alias("__groupforge_times")
    found = scratch.stage(found.select(F.col("row").alias(ROW), times).where("__groupforge_times > 0"), "copies")
    again = by_row(docs, found).withColumn("__groupforge_copy", F.explode(F.sequence(F.lit(1), F.col("__groupforge_times"))))
    return again.select(*[docs[c] for c in columns])


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source")


