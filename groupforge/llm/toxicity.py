"""A counterfactual-regularised toxicity classifier.

Logistic regression on which words a text has, which beginnings of words (for languages that inflect and compound), and which
beginnings two of its words share. Each training sentence set that names a group (an identity term) is also read
with that term swapped for others; the squared change of the score under such swaps is added to the loss, so that weight
moves from the mention of a group to what is said. Identity terms that never occur get weight 0.

Training reads at most SAMPLE labelled rows, chosen by a seeded hash of the id: that is the documented bound of what the driver
holds (word lists stay on the executors; the driver gets counts of the FEATURES best words and each sampled row's places in
that list; names of groups are kept beside the FEATURES best). Scoring is one narrow pass over whole texts, of any length: what a
text adds is its set of words. Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts get the score of no words. Without labels of both kinds all scores are the label mean,
or 0 without labels. Repeated label rows count once, toxic if any says so. Rows with null labels are not used. A null id counts
as the empty string. Only the named columns are read, so others can't clash; not_toxic() carries all of them. An empty table gives
an empty result, and one without labelled rows a score of 0.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Recent, Scratch, documents, ship, slices

SAMPLE, FEATURES, SEED, FOLDS = 12_000, 4_000, 4, 5
BEGINNINGS = (4, 5, 6, 7, 8)
#: Least log-likelihood ratio of a word's two rates; under it a word is taken for noise.
LEAST_RATIO = 15.0
RIDGE, FAIRNESS, STEPS = 1e-4, 1.0, 400

#: Names of groups, in the languages of the texts.
IDENTITY = """
women men girls boys muslims christians jews hindus atheists immigrants refugees foreigners gays lesbians transgender disabled elderly black white asian arab
femmes hommes musulmans chrétiens juifs immigrés réfugiés étrangers homosexuels handicapés
frauen männer muslime christen juden einwanderer flüchtlinge ausländer behinderte
mujeres hombres musulmanes cristianos judíos inmigrantes refugiados extranjeros discapacitados
""".split()

_WORDS = re.compile(r"[^\W\d_]+").findall


def words(text: str | None) -> set[str]:
    return set(_WORDS(text.lower())) if text else set()


def parts(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) > k)]


def features(text: str | None) -> list[str]:
    seen: dict[str, int] = {}
    for w in words(text):
        for x in parts(w):
            seen[x] = seen.get(x, 0) + 1
    return sorted([*seen, *(f"{x}*" for x, n in seen.items() if n > 1)])


def held_out(id_: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % folds == 0


def _sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, seed: int) -> DataFrame:
    """(label, words) of the training sample; the labels joined are at most about `sample` rows."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label is not null and id is not null")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    n = known.count()
    if n > sample:
        keep = int(sample / n * (1 << 62))
        known = known.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 62)) < keep)

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], ["label", "words"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(known), "id").select("label", "text")
    return rows.mapInArrow(run, "label int, words array<string>")


def log_ratio(a: Column, b: Column, na: float, nb: float) -> Column:
    """Dunning's log-likelihood ratio of two rates a/na and b/nb."""
    p = (a + b) / (na + nb)

    def part(k: Column, n: float, p: Column) -> Column:
        return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(k < n, (n - k) * F.log(1 - p)).otherwise(0.0)

    return 2 * (part(a, na, a / na) + part(b, nb, b / nb) - part(a, na, p) - part(b, nb, p))


class Classifier:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known = Recent(lambda w: tuple(x for x in parts(w) if x in weights or f"{x}*" in weights), 100_000)

    def score(self, text: str | None) -> float:
        seen: dict[str, int] = {}
        known = self.known
        for w in words(text):
            for x in known[w]:
                seen[x] = seen.get(x, 0) + 1
        get = self.weights.get
        z = self.bias + math.fsum([get(x, 0.0) for x in seen] + [get(f"{x}*", 0.0) for x, n in seen.items() if n > 1])
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def swap_gradient(of_term: np.ndarray, named: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient of the mean squared change of the logit, over all texts that name a group and all groups swapped for it.

    of_term: what naming each group adds to a text's features; named: the number of texts that name it.
    """
    adds, groups = of_term @ w, len(named)
    change = (named * adds * groups - named * adds.sum()) + (adds * named.sum() - (named * adds).sum())
    return 2 / max(1.0, named.sum() * (groups - 1)) * (change @ of_term)


def fit(rows: list[tuple[int, list[int]]], names: list[str], identity: list[str], ridge: float = RIDGE, fairness: float = FAIRNESS, steps: int = STEPS) -> Classifier:
    """rows: label and places in names. Loss: mean log loss, ridge, and fairness times the mean squared change under swaps."""
    y = np.array([r[0] for r in rows], dtype=np.float64)
    mean = float(y.mean()) if len(y) else 0.0
    if not 0 < mean < 1:
        return Classifier({}, 40.0 * (2 * mean - 1))
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    col = np.array([c for r in rows for c in r[1]], dtype=np.int64)
    place = {x: i for i, x in enumerate(names)}
    groups = sorted(set(identity))
    of_term = np.zeros((len(groups), len(names)))  # what a term adds to a text's features; nothing for terms that never occur
    named = np.zeros(len(groups))  # texts that name it
    for i, g in enumerate(groups):
        of_term[i, [place[x] for x in parts(g) if x in place]] = 1.0
        named[i] = np.count_nonzero(col == place[g]) if g in place else 0
    w, bias = np.zeros(len(names)), math.log(mean / (1 - mean))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.bincount(row, w[col], len(rows)) + bias
        gap = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(rows)
        grad = np.bincount(col, gap[row], len(w)) + ridge * w
        grad += fairness * swap_gradient(of_term, named, w)
        grad_bias = float(gap.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * grad_bias, 0.999 * vb + 0.001 * grad_bias**2
        rate, fix1, fix2 = 0.1, 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (m / fix1) / (np.sqrt(v / fix2) + 1e-8)
        bias -= rate * (mb / fix1) / (math.sqrt(vb / fix2) + 1e-8)
    return Classifier({x: float(w[i]) for i, x in enumerate(names)}, float(bias))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", identity: list[str] = IDENTITY, sample: int = SAMPLE, features: int = FEATURES, seed: int = SEED, fairness: float = FAIRNESS) -> Classifier:
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "toxicity")
    rows = scratch.stage(_sampled(docs, labels, id_col, text_col, label_col, sample, seed), "sample")
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = float(n.get(1, 0)), float(n.get(0, 0))
    if not bad or not good:
        return fit([(1, [])] * int(bad) + [(0, [])] * int(good), [], identity)
    seen = rows.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    ratio = log_ratio(F.col("a").cast("double"), F.col("b").cast("double"), bad, good)
    named = sorted({x for g in identity for x in parts(g)})
    ranked = seen.withColumn("ratio", ratio)
    best = ranked.where((F.col("ratio") >= LEAST_RATIO) & ~F.col("word").isin(named)).orderBy(F.desc("ratio"), "word").limit(features)
    names = sorted(r["word"] for r in best.select("word").unionByName(ranked.where(F.col("word").isin(named)).select("word")).collect())
    places = F.array(*[F.lit(x) for x in names]) if names else F.array().cast("array<string>")
    chosen = rows.select("label", F.array_intersect("words", places).alias("words"))
    place = {x: i for i, x in enumerate(names)}
    found = [(r["label"], [place[x] for x in r["words"]]) for r in chosen.collect()]
    scratch.drop(rows)
    return fit(found, names, identity, fairness=fairness)


def scored(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, score."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.bias))

    def run(batches):
        c = Classifier(*shared.value)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.score(t) for t in b.column(1).to_pylist()], pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, f"id {kind}, score double")


def not_toxic(docs: DataFrame, model: Classifier, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs without the rows that score at least `limit`; all columns stay. Rows are filtered where they are read."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.bias))
    at = docs.columns.index(text_col)

    def run(batches):
        c = Classifier(*shared.value)
        for b in slices(batches):
            yield b.filter(pa.array([c.score(t) < limit for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs, model)
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
