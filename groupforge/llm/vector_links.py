"""Embedding near-dedup with a pivot-permutation index (after Chavez, Figueroa and Navarro; Esuli's inverted form).

Pivots are vectors chosen by a seeded hash, without near copies of each other. A vector is described by its PREFIX nearest
pivots in order. Inverted lists hold, for each label and pivot, the vectors that have the pivot in their prefix; two vectors
are candidates if their prefixes share at least SHARED pivots, and are verified by their cosine in double precision.

A pair meets in each list of a shared pivot and is worked in that of the smallest one. Lists are worked in pairs of blocks, as
matrix products; what comes out is each vector's number of links and a star for each connected part, never all pairs. Equal
vectors of a label are one class with a number of members, so copies form no pairs either. Different vectors that all link with
each other are counted one by one, as their numbers of links are asked for: that is the one product of a group with itself.

The index is fitted on at most 4 * PIVOTS_MOST vectors and holds every vector; the number of pivots grows with the square root of
the rows, so that lists do too, up to PIVOTS_MOST (30 million vectors; lists of larger tables grow in proportion, at the same
recall). Lists, vectors and components that very many rows share are met by broadcast of a bounded number of them (common.meet).
Recall at the production parameters is measured against brute force in the tests, on planted links (at least 0.9).

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors without a label or an
id, link with nothing; their component is their id. Finite components of any magnitude are compared. Vectors of different lengths are never compared, and long ones only cost time.
Repeated rows are vectors of their own and link if they can link. kept tells whether component_id is the row's own id, so rows that
repeat the smallest id are all kept. Only the named columns are read, so others can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Merge, dealt, gathered, whole_units
from .common import Scratch, components, meet, ship, slices

COSINE, PREFIX, SHARED, BLOCK, SEED = 0.93, 8, 2, 600, 7
PIVOTS_LEAST, PIVOTS_MOST, PIVOTS_PER_ROOT = 32, 16_384, 3.0
#: A vector closer than this to a chosen pivot is none.
PIVOT_APART = 0.9


def pivots(vectors: DataFrame, n: int, seed: int = SEED) -> dict[int, np.ndarray]:
    """Unit pivots for each vector length; at most 4 * n rows reach the driver."""
    want = int(min(PIVOTS_MOST, max(PIVOTS_LEAST, PIVOTS_PER_ROOT * n**0.5)))
    share = min(1.0, 2.0 * want / max(1, n))
    drawn = vectors.withColumn("_r", F.xxhash64(F.lit(seed), "vec")).where(F.pmod(F.col("_r"), F.lit(1 << 40)) < int(share * (1 << 40)))
    rows = drawn.select("vec", "_r").orderBy("_r", "vec").limit(4 * want).collect()
    out: dict[int, np.ndarray] = {}
    by_length: dict[int, list[np.ndarray]] = {}
    for r in rows:
        v = np.array([r["vec"]], dtype=np.float64)
        by_length.setdefault(v.shape[1], []).append(_scaled(v)[0])
    for length, vs in by_length.items():
        chosen, k = np.empty((min(want, len(vs)), length)), 0
        for v in vs:
            if k < len(chosen) and not (chosen[:k] @ v > PIVOT_APART).any():
                chosen[k], k = v, k + 1
        out[length] = chosen[:k]
    return out


def prefixes(unit: np.ndarray, chosen: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """Places of the nearest pivots of each row, nearest first; of equally near ones the smaller place."""
    k = min(prefix, len(chosen))
    out = np.empty((len(unit), k), dtype=np.int32)
    for at in range(0, len(unit), 256):
        far = -(unit[at : at + 256] @ chosen.T)
        edge = np.partition(far, k - 1, axis=1)[:, k - 1 : k]
        for i, row in enumerate(far):
            near = np.flatnonzero(row <= edge[i])
            out[at + i] = near[np.argsort(row[near], kind="stable")][:k]
    return out


#: Vectors whose largest component is beyond 2^FAR or under 2^-FAR are scaled by 2^SHIFT first, which is exact, so that no square leaves the doubles.
FAR, SHIFT = 400, 600


def _scaled(v: np.ndarray) -> np.ndarray:
    """Unit vectors of rows that are finite and not zero, of any magnitude."""
    most = np.abs(v).max(axis=1, keepdims=True)
    v = np.ldexp(v, np.where(most > 2.0**FAR, -SHIFT, np.where(most < 2.0**-FAR, SHIFT, 0)))
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _units(t: pa.Table, column: int) -> np.ndarray:
    flat = t.column(column).combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    v = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    return _scaled(v)


def linked(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, prefix: int = PREFIX, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: row, id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "vectors")
    vec = F.col(vector_col).cast("array<double>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    base = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(label_col).alias("label"), vec.alias("vec"))
    nonzero = F.exists("vec", lambda x: x != 0)
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & F.coalesce(finite, F.lit(False))
    usable = usable & F.coalesce(nonzero, F.lit(False))
    base = scratch.stage(base.withColumn("ok", F.coalesce(usable, F.lit(False))), "base")
    classes = base.where("ok").groupBy("label", "vec").agg(F.min("row").alias("rep"), F.count("*").alias("copies"))
    classes = scratch.stage(classes, "classes")
    chosen = spark.sparkContext.broadcast(pivots(classes, classes.count()))
    total = base.count()

    def index(batches):
        for b in slices(batches, 2000):
            t = pa.Table.from_batches([b])
            lengths = np.diff(b.column(3).offsets.to_numpy())
            for length in np.unique(lengths):
                part = t.filter(pa.array(lengths == length)).combine_chunks()
                own = chosen.value.get(int(length))
                if own is None:
                    own = np.eye(1, int(length))
                found = prefixes(_units(part, 3), own, prefix)
                prefix_column = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.reshape(-1)))
                yield from part.append_column("pivots", prefix_column).combine_chunks().to_batches()

    kind = base.schema["label"].dataType.simpleString()
    described = classes.select("label", "rep", "copies", "vec").mapInArrow(index, f"label {kind}, rep long, copies long, vec array<double>, pivots array<int>")
    described = scratch.stage(described, "described")
    length = F.size("vec").alias("length")
    key = F.xxhash64("label", "length", "pivot").alias("key")
    postings = described.select("label", "rep", "copies", "vec", "pivots", length, F.explode("pivots").alias("pivot"))
    sizes = scratch.stage(postings.groupBy("label", "length", "pivot").agg(F.count("*").alias("members")), "sizes")
    several = sizes.where("members > 1")
    met = meet(postings, several, ["label", "length", "pivot"], "members", sizes.agg(F.sum("members")).first()[0] or 0)
    met = dealt(met.withColumn("key", key), ["key", "label", "length", "pivot"], F.ceil(F.col("members") / block), "rep")
    met = met.select("key", "pivot", "length", "low", "high", "block", "rep", "copies", "vec", "pivots", F.col("label").cast("string").alias("label"))
    met = gathered(met, ["key", "pivot", "length", "low", "high"])

    def compare(batches):
        for t, units in whole_units(batches, 5, 2000):
            starts = np.concatenate([[0], np.flatnonzero(np.diff(units)) + 1, [len(units)]])
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if e - s > 1:
                    yield from _compare_unit(t.slice(s, e - s), cosine, shared)

    links = scratch.stage(met.mapInArrow(compare, "a long, b long, n long"), "links")
    counts = links.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    parts = components(scratch, links.where("n is null").select("a", "b")).withColumnRenamed("node", "rep")
    found = classes.join(counts.hint("merge"), "rep", "left").join(parts.hint("merge"), "rep", "left")
    found = found.select("label", "vec", "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("part"))
    found = scratch.stage(found, "found")
    whole = meet(base.where("ok"), found, ["label", "vec"], "copies", total).select("row", "id", "n_links", "part")
    alone = base.where("not ok").select("row", "id", F.lit(0).cast("long").alias("n_links"), F.col("row").alias("part"))
    out = scratch.stage(whole.unionByName(alone), "parts")
    scratch.drop(base, classes, described, sizes, links, found)
    order = F.struct(F.col("id").isNull().alias("none"), "id")
    heads = scratch.stage(out.groupBy("part").agg(F.min(order).alias("first"), F.count("*").alias("size")).select("part", F.col("first.id").alias("component_id"), "size"), "heads")
    return meet(out, heads, ["part"], "size", total).select("row", "id", "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _compare_unit(t: pa.Table, cosine: float, shared: int):
    """Links of one unit: (a, null, n) counts and (a, b, null) stars. Pairs of an earlier shared pivot, or of one block of two, meet elsewhere."""
    pivot, crossing = t.column(1)[0].as_py(), t.column(3)[0].as_py() != t.column(4)[0].as_py()
    block, rep, copies = (t.column(k).to_numpy() for k in (5, 6, 7))
    # a hash key may stand for several (label, length, pivot): pairs of different ones are none
    label = np.unique(np.array(t.column(10).to_pylist(), dtype=object), return_inverse=True)[1]
    unit, near = _units(t, 8), np.array(t.column(9).to_pylist(), dtype=np.int64)
    places = np.unique(near)
    has = np.zeros((len(rep), len(places)))
    has[np.arange(len(rep))[:, None], np.searchsorted(places, near)] = 1.0
    link = unit @ unit.T >= cosine
    link &= has @ has.T >= min(shared, near.shape[1])
    earlier = has[:, places < pivot]
    link &= earlier @ earlier.T == 0
    link &= label[:, None] == label[None, :]
    if crossing:
        link &= block[:, None] != block[None, :]
    np.fill_diagonal(link, False)
    n = link @ copies
    at = np.flatnonzero(n)
    if not len(at):
        return
    merge = Merge(len(rep))
    for a in at:
        others = np.flatnonzero(link[a])
        for b in others[merge.label[others] != merge.label[a]].tolist():
            merge.union(int(a), b)
        merge.settle()
    star = np.flatnonzero(merge.label != np.arange(len(rep)))
    empty = pa.nulls(len(at), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(rep[at]), empty, pa.array(n[at].astype(np.int64))], ["a", "b", "n"])
    yield pa.RecordBatch.from_arrays([pa.array(rep[merge.label[star]]), pa.array(rep[star]), pa.nulls(len(star), pa.int64())], ["a", "b", "n"])


def op7_pivot_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


OP7_SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, * FROM embeddings),
good AS (
    SELECT r, label, embedding::DOUBLE[] AS v, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS most FROM e
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scaled AS (
    SELECT r, label, list_transform(v, lambda x: x * CASE WHEN most > pow(2.0, 400) THEN pow(2.0, -600) WHEN most < pow(2.0, -400) THEN pow(2.0, 600) ELSE 1.0 END) AS v
    FROM good WHERE most > 0),
sized AS (SELECT r, label, v, sqrt(list_inner_product(v, v)) AS size FROM scaled),
edges AS (
    SELECT a.r AS a, b.r AS b FROM sized a JOIN sized b ON a.label = b.label AND a.r <> b.r
    WHERE list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.93),
reach AS (SELECT r AS node, r AS other FROM e UNION SELECT r.node, x.b FROM reach r JOIN edges x ON r.other = x.a),
found AS (SELECT node, min(e.vec_id) AS component_id FROM reach JOIN e ON e.r = other GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, f.component_id, e.vec_id IS NOT DISTINCT FROM f.component_id AS kept
FROM e JOIN found f ON e.r = f.node LEFT JOIN counts c ON c.a = e.r
"""
