"""A training-data pipeline over documents: five stages, each written as Parquet and read again as the next one's input.

All stages take null and repeated ids (rows are told apart by a stored number), null, empty and very long texts, null sources and
languages, and an empty table, which stays empty. All but the last carry every column, whatever its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groupforge.llm import exact_dedup, near_dup, piece_queries, source_mix, toxicity
from groupforge.llm.common import Scratch, documents

#: No SQL: the classifier and the subset-sum fit can't be expressed. tests/llm/test_pipeline.py holds it against brute force.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score at least 0.5; null and empty texts have the score of no words. The model learns from the labelled rows of
    this stage's own input; without labels of both kinds nothing is learnt, and without any nothing is rejected."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.not_toxic(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: the smallest doc_id, null last, and one row of those that repeat it. Null equals empty."""
    return exact_dedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that similarities of 0.8 or more on five-word shingles connect: the smallest doc_id, null last, and one
    row of those that repeat it. Texts without words link with nothing, so all of them stay."""
    return near_dup.deduplicated(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that each source's words come to its target. A null source is one of its own; documents without words
    stay once; which of equally long ones is taken follows a hash of the id."""
    return source_mix.mixed(docs)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes each document: doc_id, source, lang, n_tokens, ids_sha256, decoded_sha256. Null and empty texts have the end id only."""
    coded = docs.select(F.struct("doc_id", "lang", "source").alias("of"), "text")
    return piece_queries.round_trips(coded, "of").select("id.doc_id", "id.lang", "id.source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing sources", mix_stage),
    ("SentencePiece", piece_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = spark.read.parquet(scratch.write(stage(spark, docs, sf_dir), f"stage{i}"))
    return docs
