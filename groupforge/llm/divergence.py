"""Source divergence audit: which terms set a source apart from its language, and how far sources of a language are from each other.

Two passes with a vocabulary automaton. The first deals documents into blocks of about BLOCK_BYTES and writes, for each block, its
texts by language and source (lower-cased, with one delimiter for all that isn't part of a term) and its distinct terms with the number
of documents that hold them; the sums over the blocks are the exact document frequencies. The second meets each block's texts with
those of its own terms that are kept, builds an automaton of them padded with the delimiter on both sides, and counts its matches. So
no task, and no broadcast, ever holds more of the vocabulary than one block shows, however many terms the corpus has.

What follows is sparse: terms that a source doesn't hold all have one probability there, so they are counted and not listed. Distances
of two sources are sums over the posting lists of terms both hold, and sums by count over the terms that each holds.

All arithmetic is in integers: 64 bits where the values are proved to fit (probabilities are at most 10^9 + 1), decimals elsewhere.

Defined results: null texts, languages and sources count as empty. Documents are rows: rows that repeat count again. A language without
kept terms has pairs of value 0 and no terms. Whole texts of any length are read (a longer one is a block of its own). Ties go by the
term's or source's bytes. Only the named columns are read, so others can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, documents, ship

LEAST_DOCS, SCALE, TOP, BLOCK_BYTES = 3, 1_000_000_000, 200, 32 << 20
#: Counts below it, a thousand million times, fit into 64 bits.
FITS = (1 << 63) // SCALE - 2
#: Pairs of postings worked at once; sources of a language up to which a task sums pairs in a matrix; parts that pairs are spread over.
PAIRS_AT_ONCE, DENSE, SPREAD = 1 << 16, 1024, 32
#: Groups that are broadcast at most (about a hundred bytes each); more are met by a salted shuffle.
GROUPS_SENT = 1 << 20

#: A-Z lower-cased; other ASCII characters than letters are delimiters; bytes of all other characters are parts of terms.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_bytes(text: bytes) -> bytes:
    """A text (UTF-8) whose terms are what bytes.split() gives."""
    return text.translate(FOLDED)


_BLOCK = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("text", pa.binary())])


def _blocks(batches):
    """Rows of texts (source is set) and rows of terms (term is set) of each block of one task."""
    task, serial = TaskContext.get().partitionId() << 32, 0
    texts: dict[tuple[str, str], list[bytes]] = defaultdict(list)
    held: dict[str, Counter] = defaultdict(Counter)
    size = 0

    def drained():
        groups = list(texts)
        packed = [pa.compress(b" ".join([b"", *texts[g], b""]), "zstd", asbytes=True) for g in groups]
        lengths = [sum(map(len, texts[g])) + len(texts[g]) + 1 for g in groups]
        n, block = len(groups), pa.scalar(task | serial, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.repeat(block, n), pa.array([g[0] for g in groups]), pa.array([g[1] for g in groups]), pa.nulls(n, pa.string()), pa.array(lengths, pa.int64()), pa.array(packed, pa.binary())], schema=_BLOCK)
        for lang, terms in held.items():
            if n := len(terms):
                named = pa.array(terms.keys(), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(block, n), pa.repeat(pa.scalar(lang), n), pa.nulls(n, pa.string()), named, pa.array(terms.values(), pa.int64()), pa.nulls(n, pa.binary())], schema=_BLOCK)

    for b in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            data = term_bytes(text)
            if size and size + len(data) > BLOCK_BYTES:
                yield from drained()
                texts.clear()
                held.clear()
                size, serial = 0, serial + 1
            texts[lang, source].append(data)
            held[lang].update(set(data.split()))
            size += len(data)
    if texts:
        yield from drained()


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64())])


def _recounted(texts: pa.Table, terms: pa.Table) -> pa.Table:
    """lang, source, term, n of one block: occurrences of its kept terms, by an automaton for each language; and for each language a row
    without source and term, whose n is the number of the terms that no earlier block holds."""
    import ahocorasick

    by_lang: dict[str, list[str]] = defaultdict(list)
    new: Counter = Counter()
    for lang, term, first in zip(*(terms[c].to_pylist() for c in ("lang", "term", "first")), strict=True):
        by_lang[lang].append(term)
        new[lang] += first
    out = [pa.table([pa.array(new.keys(), pa.string()), pa.nulls(len(new), pa.string()), pa.nulls(len(new), pa.string()), pa.array(new.values(), pa.int64())], schema=_COUNTS)]
    for lang, words in by_lang.items():
        words.sort()  # neighbours in the trie are then neighbours in memory
        automaton = ahocorasick.Automaton()
        for k, word in enumerate(words):
            automaton.add_word(f" {word} ", k)
        automaton.make_automaton()
        names = pa.array(words)
        for own, source, packed, length in zip(*(texts[c].to_pylist() for c in ("lang", "source", "text", "docs")), strict=True):
            if own == lang:
                text = pa.decompress(packed, length, "zstd", asbytes=True).decode()
                n = np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(text)), dtype=np.int32), minlength=len(words))
                met = np.flatnonzero(n)
                out.append(pa.table([pa.repeat(pa.scalar(lang), len(met)), pa.repeat(pa.scalar(source), len(met)), names.take(pa.array(met)), pa.array(n[met])], schema=_COUNTS))
    return pa.concat_tables(out)


def probability(n: Column, whole: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (N + V)); where the product could leave 64 bits, it is a decimal."""
    wide = _div(F.lit(SCALE).cast("decimal(20,0)") * (n + 1).cast("decimal(18,0)"), (whole + kept).cast("decimal(20,0)"))
    return F.when(n < FITS, _div(F.lit(SCALE).cast("long") * (n + 1), whole + kept)).otherwise(wide) + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q): at most 10^18 as probabilities are at most 10^9 + 1."""
    return _div((p - q) * (p - q), q)


def _shares(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class PairSums:
    """Sums over pairs of sources of one language, in a matrix while they are few."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.total = np.zeros((0, 0), dtype=np.int64)

    def codes(self, sources: list[str]) -> np.ndarray:
        codes = np.array([self.place.setdefault(s, len(self.place)) for s in sources], dtype=np.int64)
        if len(self.total) < len(self.place) <= DENSE:
            more = 2 * len(self.place) - len(self.total)
            self.total = np.pad(self.total, (0, more))
        return codes

    def add(self, a: np.ndarray, b: np.ndarray, value: np.ndarray):
        """Rows to give out at once, where the sources are too many for a matrix."""
        if len(self.place) <= DENSE:
            np.add.at(self.total.reshape(-1), a * len(self.total) + b, value)
            return
        keys, at = np.unique(a * len(self.place) + b, return_inverse=True)
        total = np.zeros(len(keys), dtype=np.int64)
        np.add.at(total, at, value)
        yield keys // len(self.place), keys % len(self.place), total

    def rest(self):
        a, b = np.nonzero(self.total)
        yield a, b, self.total[a, b]


def _pair_sums(batches):
    """lang, a, b, v: for posting lists (lang, held: source, p, p0), what terms that a and b both hold add to the sums by source."""
    sums: dict[str, PairSums] = defaultdict(PairSums)

    def rows(lang, found):
        for a, b, value in found or ():
            if len(a):
                names = pa.array(list(sums[lang].place), pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(a)), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(value)], ["lang", "a", "b", "v"])

    for batch in batches:
        for lang in pc.unique(batch.column(0)).to_pylist():
            lists = batch.column(1).filter(pc.equal(batch.column(0), lang))
            entries, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy()
            source = entries.field("source").dictionary_encode()
            code = sums[lang].codes(source.dictionary.to_pylist())[source.indices.to_numpy()]
            p, p0 = (entries.field(k).to_numpy() for k in ("p", "p0"))
            row = np.repeat(np.arange(len(sizes)), sizes)
            start, cost = np.cumsum(sizes) - sizes, np.cumsum(sizes[row])
            begin = 0
            while begin < len(row):
                end = max(begin + 1, int(np.searchsorted(cost, (cost[begin - 1] if begin else 0) + PAIRS_AT_ONCE, "right")))
                k = sizes[row[begin:end]]
                i = np.repeat(np.arange(begin, end), k)
                j = np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k) + start[row[i]]
                i, j = i[i != j], j[i != j]
                own, other, own0, other0 = p[i], p[j], p0[i], p0[j]
                value = _shares(own, other) - _shares(own, other0) - _shares(own0, other) + _shares(own0, other0)
                yield from rows(lang, sums[lang].add(code[i], code[j], value))
                begin = end
    for lang, s in sums.items():
        yield from rows(lang, s.rest())


def _by_term(rows: DataFrame) -> DataFrame:
    """Rows dealt by language and term, with a hash of both as first key of what follows, so that sorts mostly compare numbers."""
    return rows.repartition("lang", "term").withColumn("_h", F.xxhash64("lang", "term"))


def counts(docs: DataFrame, scratch: Scratch, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n) of kept terms by source (and rows without term, see _recounted), and lang, source, kept (terms that the language keeps), whole (occurrences of kept
    terms in the group), lang_n (in the language) of every group. Both are written tables of scratch."""
    ship(docs.sparkSession)
    empty = F.lit("")
    base = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]).withColumn("text", F.col("text").cast("binary"))
    blocks = scratch.stage(base.mapInArrow(_blocks, "block long, lang string, source string, term string, docs long, text binary"), "blocks")
    one = W.partitionBy("_h", "lang", "term")
    held = _by_term(blocks.where("term is not null").select("block", "lang", "term", "docs"))
    held = held.select("block", "lang", "term", F.sum("docs").over(one).alias("in"), (F.col("block") == F.min("block").over(one)).alias("first")).where(F.col("in") >= least_docs)
    texts = blocks.where("text is not null").select("block", "lang", "source", "docs", "text")
    each = texts.groupBy("block").cogroup(held.select("block", "lang", "term", "first").groupBy("block")).applyInArrow(_recounted, "lang string, source string, term string, n long")
    # dealt before it is summed: within a block no term of a source comes twice, so sums before the shuffle would find nothing to do
    counted = scratch.stage(each.repartition("lang", "source", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), "counted")
    found = counted.where("term is not null")
    kept = counted.where("term is null").select("lang", F.col("n").alias("kept"))
    sums = found.groupBy("lang", "source").agg(F.sum("n").alias("whole"))
    groups = texts.select("lang", "source").distinct().join(kept.hint("merge"), "lang", "left").join(sums.hint("merge"), ["lang", "source"], "left").fillna(0, ["kept", "whole"])
    groups = scratch.stage(groups.withColumn("lang_n", F.sum("whole").over(W.partitionBy("lang"))), "groups")
    scratch.drop(blocks)
    return counted, groups


def _met(rows: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """rows with what is known of their group: broadcast up to GROUPS_SENT groups, else by a shuffle in which a group is spread."""
    if n <= GROUPS_SENT:
        return rows.join(F.broadcast(groups), ["lang", "source"])
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c not in ("lang", "source")]), F.lit(SPREAD))).join(salted.hint("merge"), ["lang", "source", "salt"]).drop("salt")


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (`pair`, `term`), item, value, rank."""
    scratch = Scratch(docs.sparkSession, "divergence")
    counted, groups = counts(docs, scratch, lang_col, source_col, text_col, least_docs)
    found = counted.where("term is not null")
    # a language without kept terms has no posting, so its probabilities are never read
    stats = groups.withColumn("p0", F.when(F.col("kept") > 0, probability(F.lit(0), F.col("whole"), F.col("kept"))))
    n = groups.count()
    own = probability(F.col("n"), F.col("whole"), F.col("kept")).alias("p")
    alike = scratch.stage(_met(found.groupBy("lang", "source", "n").agg(F.count("*").alias("m")), stats, n).select("lang", "source", "m", "p0", own), "alike")
    lists = _by_term(_met(found, stats, n).select("lang", "term", "source", "n", "p0", own, "lang_n", "kept"))
    lists = lists.groupBy("_h", "lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("held"), F.sum("n").alias("all"), F.first("lang_n").alias("lang_n"), F.first("kept").alias("kept"))
    lists = scratch.stage(lists.select("lang", "term", "held", probability(F.col("all"), F.col("lang_n"), F.col("kept")).alias("q")), "lists")
    scratch.drop(counted)

    best = lists.select("lang", "term", "q", F.explode("held").alias("h")).where("h.p > q")
    best = best.select("lang", F.col("h.source").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("h.p"), F.col("q")).alias("value"))
    by_value = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    best = best.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    # both hold the term: by posting list; one holds it: by the terms of equal count; neither: by number
    wide = "decimal(38,0)"
    both = lists.where(F.size("held") > 1).select("lang", "held").mapInArrow(_pair_sums, "lang string, a string, b string, v long").select("lang", "a", "b", F.col("v").cast(wide).alias("v"))
    other = stats.select("lang", F.col("source").alias("other"), F.col("p0").alias("other_p0"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("salt"))
    spread = alike.withColumn("salt", F.pmod(F.xxhash64("source", "p"), F.lit(SPREAD))).join(other.hint("merge"), ["lang", "salt"]).where("source <> other")
    p, p0, q0, m = F.col("p"), F.col("p0"), F.col("other_p0"), F.col("m").cast("decimal(18,0)")
    as_group = F.struct(F.col("source").alias("a"), F.col("other").alias("b"), (m * (divergence(p, q0) - divergence(p0, q0)).cast("decimal(19,0)")).cast(wide).alias("v"))
    as_other = F.struct(F.col("other").alias("a"), F.col("source").alias("b"), (m * (divergence(q0, p) - divergence(q0, p0)).cast("decimal(19,0)")).cast(wide).alias("v"))
    one = spread.select("lang", F.explode(F.array(as_group, as_other)).alias("s")).select("lang", "s.*")
    every = stats.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(SPREAD))).join(other.hint("merge"), ["lang", "salt"]).where("source <> other")
    neither = F.when(F.col("kept") > 0, F.col("kept").cast("decimal(18,0)") * divergence(p0, q0).cast("decimal(19,0)")).otherwise(F.lit(0).cast(wide))
    every = every.select("lang", F.col("source").alias("a"), F.col("other").alias("b"), neither.cast(wide).alias("v"))
    pairs = both.unionByName(one).unionByName(every).groupBy("lang", "a", "b").agg(F.sum("v").cast("long").alias("value"))
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value").withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(best)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


OP12_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (
    SELECT g.lang, g.source, coalesce(v.v, 0) AS v, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g
    LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s USING (lang, source)),
lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
l AS (SELECT lang, sum(n) AS n FROM c GROUP BY lang),
p AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS held, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0)::HUGEINT + 1)) // (g.n::HUGEINT + g.v) AS p
    FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lc.lang, lc.term, 1 + (1000000000::HUGEINT * (lc.n::HUGEINT + 1)) // (l.n::HUGEINT + v.v) AS q FROM lc JOIN l USING (lang) JOIN v USING (lang)),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::HUGEINT AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
    UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source AND a.v = 0),
terms AS (
    SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q) * (p.p - q.q) // q.q AS value
    FROM p JOIN q USING (lang, term) WHERE p.held > 0 AND p.p > q.q),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
