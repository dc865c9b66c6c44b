"""Filter interaction audit: what each filter of a chain removes, in every order of the filters.

Whether a text fails filters A to D is a matter of the text alone. Filter E fails a document whose text a smaller id has too: texts are
routed as an RDD by their xxhash to partitions that hold chains of colliding texts in full, each with its smallest id; ids that aren't
the smallest of their text come out. The five results are a mask of five bits, and all that is asked of any order can be told from the
numbers of documents by source and mask, which combineByKey merges as count vectors.

Copies are folded where they are read, before the shuffle: a task sends each text it holds once, with its smallest id, and ids that
can't be the smallest go on without their text, spread by their own hash. So a text that a third of all rows share is one record a
task. Stores are bounded: a fold is sent on when it holds HELD_BYTES, which costs a record more and changes nothing, and there are as
many routed partitions as the measured bytes of all texts ask for at ROUTE_BYTES each. Both RDDs come from the scan by narrow steps and
one shuffle, so lost executors cost a recomputation and no result.

Defined results: a null text counts as empty, which fails A (and E if a smaller id has an empty text). A null source is the part ''. A
null id is larger than all others and smaller than none; rows that repeat an id are documents of their own, and one isn't smaller than
the other. A document is good or toxic if any row of labels says so. Whole texts of any length are read. Only the named columns are
read, so others can't clash. An empty table has no part and gives an empty result.
"""

from __future__ import annotations

from itertools import permutations

import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ship

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
COPY = 1 << LETTERS.index("E")
#: Fewest words; least distinct words and most capitals, in per cent; characters that fail a text.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 50, 65, 5, b"#$%&*|"
HELD_BYTES, ROUTE_BYTES = 32 << 20, 16 << 20

CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
CONTINUED = bytes(range(0x80, 0xC0))


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text (UTF-8) fails. bytes.split() cuts at just the six white space characters of the words."""
    words = text.split()
    n, points = len(words), len(text.translate(None, CONTINUED))
    few = n < LEAST_WORDS
    poor = 100 * len(set(words)) < LEAST_DISTINCT * n
    loud = 100 * (len(text) - len(text.translate(None, CAPITALS))) > MOST_CAPITALS * points
    marked = any(m in text for m in MARKS)
    return few | poor << 1 | loud << 2 | marked << 3


class Chains:
    """Texts by fingerprint; a chain holds colliding texts in full, each with its smallest id and the numbers of rows of that id by part."""

    def __init__(self):
        self.held: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, fingerprint: int, text: bytes, id, mask: int, rows: dict) -> list[tuple]:
        """Takes rows of one text and id; gives back (id, part, mask, rows) of those that aren't the smallest."""
        chain = self.held.setdefault(fingerprint, [])
        own = next((e for e in chain if e[0] == text), None)
        if own is None:
            chain.append([text, id, mask, dict(rows)])
            self.bytes += len(text) + 200
            return []
        if own[1] == id:
            for part, n in rows.items():
                own[3][part] = own[3].get(part, 0) + n
            return []
        if (id is None, id) < (own[1] is None, own[1]):
            own[1], id, own[3], rows = id, own[1], dict(rows), own[3]
        return [(id, part, mask | COPY, n) for part, n in rows.items()]

    def drain(self):
        for fingerprint, chain in self.held.items():
            for text, id, mask, rows in chain:
                yield fingerprint, (text, id, mask, rows)
        self.held, self.bytes = {}, 0


def _folded(rows):
    """(route, record) of one partition's documents: a text with its smallest id, or a row that isn't the smallest, without its text."""
    chains = Chains()
    for id, source, text in rows:
        data = text.encode()
        for late in chains.add(xxhash.xxh64_intdigest(data), data, id, failures(data), {source: 1}):
            yield xxhash.xxh64_intdigest(repr(late[0])), (None, *late)
        if chains.bytes > HELD_BYTES:
            yield from chains.drain()
    yield from chains.drain()


def _resolved(routed):
    """(id, part, mask, rows) of one routed partition."""
    chains = Chains()
    for fingerprint, record in routed:
        if record[0] is None:
            yield record[1:]
        else:
            text, id, mask, rows = record
            yield from chains.add(fingerprint, text, id, mask, rows)
    for _, (_, id, mask, rows) in chains.drain():
        for part, n in rows.items():
            yield id, part, mask, n


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, part, mask, rows: documents by id, source and the filters they fail (bit 0: A)."""
    spark = docs.sparkSession
    ship(spark)
    empty = F.lit("")
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), empty).alias("source"), F.coalesce(F.col(text_col).cast("string"), empty).alias("text"))
    routes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // ROUTE_BYTES)
    read: RDD = base.rdd
    routed = read.mapPartitions(_folded).partitionBy(routes, lambda h: h)
    kind = docs.schema[id_col].dataType.simpleString()
    return spark.createDataFrame(routed.mapPartitions(_resolved), f"id {kind}, part string, mask int, rows long", verifySchema=False)


def _count(vector: list[int], value: tuple) -> list[int]:
    mask, good, toxic, n = value
    for k in range(3):
        vector[3 * mask + k] += n * (1, good, toxic)[k]
    return vector


def vectors(found: DataFrame, labels: DataFrame) -> RDD:
    """(part, counts): documents, good ones and toxic ones of each of the 32 masks. labels: doc_id, quality, toxic."""
    said = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # rows of one id are few before they meet its labels, and so are those of null ids, which meet none
    each = found.groupBy("id", "part", "mask").agg(F.sum("rows").alias("n"))
    zero = F.lit(0)
    known = each.join(said.hint("merge"), "id", "left").select("part", "mask", F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"), "n")
    pairs = known.rdd.map(lambda r: (r[0], tuple(r[1:])))
    return pairs.combineByKey(lambda v: _count([0] * 96, v), _count, lambda a, b: [x + y for x, y in zip(a, b, strict=True)], int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def steps(part: str, counts: list[int]):
    """Rows of one part: (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    total = sum(counts[::3])
    masks_ = range(1 << len(LETTERS))
    # of the 120 orders, each filter that a document fails comes first among those in an equal share
    share = {f: sum(counts[3 * m] * (len(ORDERS) // m.bit_count()) for m in masks_ if m >> f & 1) for f in range(len(LETTERS))}
    for order in ORDERS:
        seen, kept = 0, total
        for step, letter in enumerate(order, 1):
            f = LETTERS.index(letter)
            failing = [m for m in masks_ if m >> f & 1]
            here = [m for m in failing if not m & seen]
            removed, good, toxic = (sum(counts[3 * m + k] for m in here) for k in range(3))
            kept -= removed
            yield part, order, step, kept, removed, sum(counts[3 * m] for m in failing) - removed, counts[3 << f], good, toxic, share[f]
            seen |= 1 << f


COLUMNS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step."""
    counted = vectors(masks(docs, id_col, text_col, source_col), labels)
    return docs.sparkSession.createDataFrame(counted.flatMap(lambda pair: steps(*pair)), COLUMNS, verifySchema=False)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
m AS (
    SELECT part, CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN coalesce(first_id < doc_id, first_id IS NOT NULL) THEN 'E' ELSE '' END AS fails,
        doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
    FROM w),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS f, left(filter_order, step - 1) AS earlier FROM o, range(1, 6) r(step)),
j AS (
    SELECT part, filter_order, step, n, good, toxic, fails = f AS alone, contains(fails, f) AS failing,
        earlier <> '' AND len(fails) > 0 AND regexp_matches(fails, '[' || CASE earlier WHEN '' THEN 'Z' ELSE earlier END || ']') AS gone, f
    FROM c, s),
r AS (
    SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (failing AND NOT gone), 0) AS removed,
        coalesce(sum(n) FILTER (failing AND gone), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
        coalesce(sum(good) FILTER (failing AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (failing AND NOT gone), 0) AS toxic_lost
    FROM j GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM r
"""
