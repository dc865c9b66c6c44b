"""Exact deduplication by deterministic block naming (after Karp, Miller and Rosenberg), in DataFrame operations only.

A text, with each run of white space as one space, is cut into blocks of a fixed number of bytes. Equal blocks get the same
integer, their place in the sorted order of distinct blocks. Then the names of adjacent blocks are paired and distinct pairs
get integers the same way, level by level, until one integer is left: texts are equal exactly if level count and integer are.

Blocks travel once, as distinct blocks, which are deduplicated before the shuffle; all else moves 128-bit hashes of blocks.
Hashes are proved free of collisions over the blocks at hand: blocks whose hash another block shares are named by content.
Blocks, pairs and texts that very many rows share are met by broadcast of a bounded number of them (common.meet).

Defined results: a null text counts as empty. Of rows with equal texts the one with the smallest doc_id is kept (null last);
of rows that repeat that doc_id, one. Very long texts are many blocks, each a row of its own. Other columns than the two named
are not read, so their names can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, Scratch, by_row, documents, meet, numbered, ranked, row_number

BLOCK_BYTES = 4096


def normalised(text: Column) -> Column:
    """Each run of white space as one space; single spaces are left alone, which gives the same and is faster."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _blocks(docs: DataFrame, text_col: str, block_bytes: int) -> DataFrame:
    """Adds _data, _n and _cut. Explode _cut with the outer form: it is never empty, and the inner form computes it twice."""
    data = normalised(F.col(text_col)).cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("_data") / block_bytes).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.substring(F.col("_data"), i * block_bytes + 1, F.lit(block_bytes)))
    return docs.withColumn("_data", data).withColumn("_n", n).withColumn("_cut", cut)


def _hashes(block: Column, hash_bits: int) -> list[Column]:
    """Two 64-bit hashes; hash_bits under 64 is for tests that force collisions."""
    one, two = F.xxhash64(block), F.xxhash64(F.lit(7), block)
    return [one, two] if hash_bits >= 64 else [F.pmod(one, F.lit(1 << hash_bits)), F.lit(0).cast("long")]


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hash_bits: int = 64, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs: row (its place in the scan), id, text_sha256, depth and name: equal for equal texts only."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "exact")
    base = docs.select(row_number(docs).alias(ROW), F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    h1, h2 = _hashes(F.col("block"), hash_bits)

    def places() -> DataFrame:
        cut = _blocks(base.withColumnRenamed(ROW, "row"), "_text", block_bytes)
        rows = cut.select("row", "id", F.sha2("_data", 256).alias("sha"), "_n", F.posexplode_outer("_cut").alias("pos", "block"))
        first = F.when(F.col("pos") == 0, F.col("sha"))
        return scratch.stage(rows.select("row", "id", first.alias("sha"), F.col("_n").alias("n"), "pos", h1.alias("h1"), h2.alias("h2")), "blocks")

    rows = places()
    total = rows.count()

    def contents() -> DataFrame:
        return _blocks(base, "_text", block_bytes).select(F.explode_outer("_cut").alias("block")).select(h1.alias("h1"), h2.alias("h2"), "block")

    variants = contents().distinct().groupBy("h1", "h2").agg(F.count("*").alias("variants"))
    shared = scratch.stage(variants.where("variants > 1").select("h1", "h2"), "shared")
    hashes = rows.groupBy("h1", "h2").agg(F.count("*").alias("uses"))
    if shared.isEmpty():
        names = scratch.stage(ranked(hashes, ["h1", "h2"], "name", total), "names")
        level = meet(rows, names, ["h1", "h2"], "uses", total)
    else:  # named by content where a hash stands for several blocks; texts meet their rows again, so the numbers are stored
        if ROW not in docs.columns:
            base = scratch.stage(base, "numbered")
            rows = places()
        alike = contents().join(shared, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "block").agg(F.count("*").alias("uses"))
        alone = rows.groupBy("h1", "h2").agg(F.count("*").alias("uses")).join(shared, ["h1", "h2"], "left_anti").withColumn("block", F.lit(None).cast("binary"))
        names = scratch.stage(ranked(alone.unionByName(alike), ["h1", "h2", "block"], "name", total), "names")
        plain = meet(rows, names.where("block is null").drop("block"), ["h1", "h2"], "uses", total)
        again = _blocks(base.withColumnRenamed(ROW, "row"), "_text", block_bytes)
        again = scratch.stage(again.select("row", F.posexplode_outer("_cut").alias("pos", "block")).withColumn("h1", h1).withColumn("h2", h2).join(shared, ["h1", "h2"], "left_semi"), "again")
        again = meet(again, names.where("block is not null"), ["h1", "h2", "block"], "uses", total).select("row", "pos", "name")
        level = plain.select(*rows.columns, "name").unionByName(rows.join(again, ["row", "pos"]).select(*rows.columns, "name"))
    level = scratch.stage(level.select("row", "id", "sha", "n", "pos", "name"), "level")
    scratch.drop(rows, names)
    depth, done = 0, [level.where("n = 1").select("row", "id", "sha", F.lit(0).alias("depth"), "name")]
    most = level.agg(F.max("n")).first()[0] or 1
    level = level.where("n > 1")
    while most > 1:
        depth += 1
        even = F.col("pos") % 2 == 0
        pairs = level.groupBy("row", F.shiftright("pos", 1).alias("pos")).agg(
            F.max("id").alias("id"), F.max("sha").alias("sha"), F.max("n").alias("n"),
            F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(0)).alias("b"),
        )
        pairs = scratch.stage(pairs, f"pairs{depth}")
        total = pairs.count()
        names = scratch.stage(ranked(pairs.groupBy("a", "b").agg(F.count("*").alias("uses")), ["a", "b"], "name", total), f"names{depth}")
        half = ((F.col("n") + 1) / 2).cast("int").alias("n")
        level = scratch.stage(meet(pairs, names, ["a", "b"], "uses", total).select("row", "id", "sha", half, "pos", "name"), f"level{depth}")
        scratch.drop(pairs, names)
        done.append(level.where("n = 1").select("row", "id", "sha", F.lit(depth).alias("depth"), "name"))
        level, most = level.where("n > 1"), (most + 1) // 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("sha", "text_sha256")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """One row per row of docs: row, id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(docs.sparkSession, "exact")
    found = identities(docs, id_col, text_col, scratch=scratch, **more)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    groups = found.groupBy("depth", "name").agg(F.min(order).alias("first"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = scratch.stage(groups.select("depth", "name", "group_size", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row")), "groups")
    met = meet(found, groups, ["depth", "name"], "group_size", found.count(), "left")
    alone = F.col("group_size").isNull()
    return met.select(
        "row", "id", F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256",
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """docs without its rows that repeat another's text; all columns stay."""
    scratch = Scratch(docs.sparkSession, "exact-away")
    docs = numbered(scratch, docs)
    away = scratch.stage(exact_groups(docs, id_col, text_col, **more).where("not kept").select(F.col("row").alias(ROW)), "away")
    return by_row(docs, away, how="left_anti").drop(ROW)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
