"""MinHash near-deduplication with sequential Bayesian verification (after Satuluri and Parthasarathy's BayesLSH).

1. One pass over the texts: each document's set of distinct word shingles, as 64-bit hashes; its size and 128-bit fingerprint;
   MinHash values, cut into bands. Documents with equal sets become one class, so exact copies never form pairs.
2. Classes that share a band's values are candidates. They are compared inside their band's group by batches of signature
   bytes: after each batch a pair goes whose posterior probability of reaching the similarity is below MISS. Each unit of work
   emits a star for each connected part of surviving pairs, not the pairs; the stars' components are clusters, and each link
   lies within a cluster.
3. Each cluster's documents meet with their full sets: pairs that the whole signature does not rule out and that no path joins
   yet are verified exactly. Again stars come out, whose components are the result.

Groups and clusters of any size are worked in blocks, of a bounded number of rows and bytes (blocks.py): members of a large one
are dealt into two blocks each, and only what is left in different components after that meets again, so near copies of one text
cost time linear in their number. Sets, bands, clusters and components that very many rows share are met by broadcast of a bounded
number of them (common.meet). Texts are shuffled once to leave those without candidates; those of clusters are written, and shuffled
once or twice more.
A link at similarity s is missed with probability (1 - s**ROWS)**BANDS in step 2 (5e-6 at 0.8) plus about MISS.

Defined results: null, empty and blank texts have no shingles and link with nothing; texts of fewer words than a shingle have
one shingle, all their words; very long ones are whole sets. component_id is the smallest id of the component, a null id only where
all are null; kept tells whether it is the row's own id, so rows that repeat that id are all kept, while deduplicated() leaves one
row of each component. Only the named columns are read, so others can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import apart, connect, gathered, joined_up, once, whole_units
from .common import ROW, Scratch, by_row, documents, meet, numbered, row_number, ship, slices

WORDS, PERCENT = 5, 80
BANDS, ROWS, BATCH, MISS = 40, 6, 16, 1e-7
#: Signature bytes that travel with each band's group, and members of a block in steps 2 and 3; bytes of texts in a block of step 3.
FIRST_BYTES, GROUP_BLOCK, CLUSTER_BLOCK, BLOCK_BYTES = 64, 2000, 400, 16 << 20

_rng = np.random.Generator(np.random.PCG64(9))
_MULTIPLY = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles. Only A-Z are lower-cased, and only ASCII white space parts words."""
    parts = text.encode().lower().split() if text else []
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, parts)), dtype=np.uint64)
    k = min(words, len(parts))
    out = np.full(len(parts) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def minima(hashes: np.ndarray) -> np.ndarray:
    """BANDS * ROWS MinHash values, over slices of bounded memory."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(_ADD), np.uint32(0xFFFFFFFF))
    for at in range(0, len(low), 2048):
        part = np.multiply.outer(_MULTIPLY, low[at : at + 2048])
        part += _ADD[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return best


def least_equal(n: int, equal_bits: int = 8, similarity: float = PERCENT / 100, miss: float = MISS, step: int = BATCH) -> list[tuple[int, int]]:
    """(signature bytes seen, least number of equal ones): below it the similarity is reached with probability under miss.

    Uniform prior; bytes of unequal values agree with probability 2**-equal_bits. A grid of 2000 similarities.
    """
    grid = (np.arange(2000) + 0.5) / 2000
    agree = grid + (1 - grid) / (1 << equal_bits)
    above = grid >= similarity
    out = []
    for seen in range(step, n + 1, step):
        for equal in range(seen + 1):
            logs = equal * np.log(agree) + (seen - equal) * np.log1p(-agree)
            weight = np.exp(logs - logs.max())
            if weight[above].sum() / weight.sum() >= miss:
                break
        out.append((seen, equal))
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """One row per row of docs: row, id, n, fingerprint (two longs), bands (longs that hold the band), bytes, length (of the text, in bytes)."""
    ship(docs.sparkSession)
    salt = np.arange(BANDS, dtype=np.uint64)

    def run(batches):
        for b in slices(batches):
            n, one, two, bands, data = [], [], [], [], []
            for text in b.column(2).to_pylist():
                s = shingles(text, words)
                print_ = xxhash.xxh3_128_digest(s.tobytes())
                m = minima(s)
                key = salt + np.uint64(1)
                for r in range(ROWS):
                    key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + m[r::ROWS])
                n.append(len(s))
                one.append(int.from_bytes(print_[:8], "little", signed=True))
                two.append(int.from_bytes(print_[8:], "little", signed=True))
                bands.append(key.astype(np.int64))
                data.append((m & np.uint32(255)).astype(np.uint8).tobytes())
            bands_ = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(bands) if bands else np.zeros(0, dtype=np.int64)))
            columns = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), bands_, pa.array(data, pa.binary()), b.column(3)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "n", "one", "two", "bands", "bytes", "length"])

    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(row_number(docs).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    base = base.withColumn("length", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return base.mapInArrow(run, f"row long, id {kind}, n long, one long, two long, bands array<long>, bytes binary, length long")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def _stars(rows: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(rows[label[at]]), pa.array(rows[at])], ["a", "b"])


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, miss: float = MISS, group_block: int = GROUP_BLOCK, cluster_block: int = CLUSTER_BLOCK) -> DataFrame:
    """One row per row of docs: row, id, n_shingles, component_id, kept, head (one row of each component, of the smallest id)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    named = docs.select(*[ROW for c in docs.columns if c == ROW], F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = numbered(scratch, named)
    marks = scratch.stage(signatures(docs, "id", "text", words), "marks")
    total = marks.count()
    least = least_equal(BANDS * ROWS, similarity=percent / 100, miss=miss)
    early = [x for x in least if x[0] <= FIRST_BYTES]

    classes = marks.where("n > 0").groupBy("one", "two", "n").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
    classes = scratch.stage(classes, "classes")
    clusters = _clusters(scratch, marks, classes, early, percent, group_block)
    found = _verified(scratch, docs, marks, clusters, least, words, percent, cluster_block)

    joined = classes.join(found.withColumnRenamed("node", "row").hint("merge"), "row", "left").select("one", "two", "n", "copies", F.coalesce("component", "row").alias("part"))
    joined = scratch.stage(joined, "joined")
    out = meet(marks.select("row", "id", "n", "one", "two"), joined, ["one", "two", "n"], "copies", total, "left").withColumn("part", F.coalesce("part", "row"))
    out = scratch.stage(out.select("row", "id", "n", "part"), "parts")
    scratch.drop(marks, classes, clusters, joined)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    heads = out.groupBy("part").agg(F.min(order).alias("first"), F.count("*").alias("size"))
    heads = scratch.stage(heads.select("part", F.col("first.id").alias("component_id"), F.col("first.row").alias("head_row"), "size"), "heads")
    met = meet(out, heads, ["part"], "size", total)
    return met.select("row", "id", F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), (F.col("row") == F.col("head_row")).alias("head"))


def _clusters(scratch: Scratch, marks: DataFrame, classes: DataFrame, early: list[tuple[int, int]], percent: int, group_block: int) -> DataFrame:
    """row, cluster of the classes that a candidate pair, likely by its first signature bytes, joins to another."""
    bands = marks.join(classes.select("row").hint("merge"), "row", "left_semi").select("row", F.explode("bands").alias("key"))
    bands = scratch.stage(bands, "bands")
    shared = scratch.stage(bands.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "shared")
    pairs = scratch.stage(meet(bands, shared, ["key"], "members", bands.count()), "pairs")
    scratch.drop(bands, shared)
    first = marks.select("row", "n", F.substring("bytes", 1, FIRST_BYTES).alias("bytes")).hint("merge")

    def stars(units: DataFrame, labelled: bool) -> DataFrame:
        def compare(batches):
            for t, unit in whole_units(batches, 3, 20_000):
                low, high, block, rows, n = (t.column(k).to_numpy() for k in (1, 2, 3, 4, 5))
                yield _stars(rows, connect(unit, low != high, block, n, _matrix(t.column(6), FIRST_BYTES), early, percent, part=t.column(7).to_numpy() if labelled else None))

        columns = ["key", "low", "high", "block", "row", "n", "bytes", *(["part"] if labelled else [])]
        return gathered(units.join(first, "row").select(*columns), columns[:3]).mapInArrow(compare, "a long, b long")

    def again(parts: DataFrame) -> DataFrame | None:
        large = pairs.where(F.col("members") > group_block).select("key", "row", F.lit(group_block).alias("size"))
        left = apart(large, "key", "row", "size", scratch, parts)
        return None if left is None else stars(left, True)

    likely = joined_up(scratch, stars(once(pairs, "key", F.ceil(F.col("members") / group_block), "row", 2), False), again)
    return scratch.stage(likely.select(F.col("node").alias("row"), F.col("component").alias("cluster")), "clusters")


def _verified(scratch: Scratch, docs: DataFrame, marks: DataFrame, clusters: DataFrame, least: list[tuple[int, int]], words: int, percent: int, cluster_block: int) -> DataFrame:
    """node, component of links that hold for the full sets."""
    held = clusters.join(marks.select("row", "length").hint("merge"), "row")
    sizes = held.groupBy("cluster").agg(F.count("*").alias("members"), F.sum("length").alias("length"))
    blocks = F.ceil(F.greatest(F.col("members") / cluster_block, F.col("length") / BLOCK_BYTES)).cast("int")
    sizes = scratch.stage(sizes.select("cluster", "members", F.least(blocks, F.col("members").cast("int")).alias("blocks")), "sizes")
    likely = scratch.stage(meet(clusters, sizes, ["cluster"], "members", clusters.count()), "likely")
    texts = by_row(docs.select(F.col(ROW).alias("row"), "text"), likely, "row")
    texts = scratch.stage(texts.join(marks.select("row", "n", "bytes").hint("merge"), "row"), "texts")

    def stars(units: DataFrame, labelled: bool) -> DataFrame:
        def verify(batches):
            for t, unit in whole_units(batches, 3, 1000):
                low, high, block, rows, n = (t.column(k).to_numpy() for k in (1, 2, 3, 4, 5))
                text = t.column(7)
                sets: dict[int, np.ndarray] = {}

                def of(a: int) -> np.ndarray:
                    if a not in sets:  # noqa: B023
                        sets[a] = shingles(text[a].as_py(), words)  # noqa: B023
                    return sets[a]  # noqa: B023

                def linked(a: int, b: int) -> bool:
                    x, y = of(a), of(b)  # noqa: B023
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    return 100 * both >= percent * (len(x) + len(y) - both)

                yield _stars(rows, connect(unit, low != high, block, n, _matrix(t.column(6), BANDS * ROWS), least, percent, linked, t.column(8).to_numpy() if labelled else None))

        columns = ["cluster", "low", "high", "block", "row", "n", "bytes", "text", *(["part"] if labelled else [])]
        return gathered(units.select(*columns), columns[:3]).mapInArrow(verify, "a long, b long")

    def again(parts: DataFrame) -> DataFrame | None:
        large = likely.where("blocks > 1").select("cluster", "row", F.ceil(F.col("members") / F.col("blocks")).cast("int").alias("size"))
        left = apart(large, "cluster", "row", "size", scratch, parts)
        return None if left is None else stars(by_row(texts.select("row", "n", "bytes", "text"), left, "row"), True)

    found = joined_up(scratch, stars(once(texts, "cluster", F.col("blocks"), "row", 2), False), again)
    scratch.drop(likely, sizes, texts)
    return found


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """docs with one row of each component; all columns stay."""
    scratch = Scratch(docs.sparkSession, "near-away")
    docs = numbered(scratch, docs)
    away = scratch.stage(near_groups(docs, id_col, text_col, **more).where("not head").select(F.col("row").alias(ROW)), "away")
    return by_row(docs, away, how="left_anti").drop(ROW)


def op9_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), words=4, percent=80).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


OP9_SQL = r"""
WITH RECURSIVE words AS (
    SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
sets AS (
    SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
    FROM words),
flat AS (SELECT r, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
    SELECT a.r AS a, b.r AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb
    FROM flat a JOIN flat b ON a.x = b.x AND a.r < b.r GROUP BY a.r, b.r),
links AS (SELECT a, b FROM pairs WHERE 100 * k >= 80 * (na + nb - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT r AS node, r AS other FROM sets UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a),
found AS (SELECT node, min(s.doc_id) AS component_id FROM reach JOIN sets s ON s.r = other GROUP BY node)
SELECT s.doc_id, len(s.s) AS n_shingles, f.component_id, s.doc_id IS NOT DISTINCT FROM f.component_id AS kept FROM sets s JOIN found f ON s.r = f.node
"""


def miss_probability(similarity: float) -> float:
    return (1 - similarity**ROWS) ** BANDS + MISS
