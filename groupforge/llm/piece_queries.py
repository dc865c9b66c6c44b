"""SentencePiece encoding and decoding by prefix tables, and token counts with the whole-token shortcut.

Both are one narrow pass over the texts: no shuffle, no state beside bounded caches of short strings.

Defined results: a null text counts as empty; an empty text has the end id only (encoding) or no token (counts). Very long
texts are cut into pre-tokens first, and long pre-tokens are never cached. Rows that repeat are handled each on its own. Only
the named columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pieces
from .common import documents, file_bytes, ship, slices

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIMIT = 4096


def _model(spark: SparkSession, path: str) -> pieces.PieceModel:
    ship(spark)
    return pieces.PieceModel(file_bytes(spark, path))


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL, end: bool = True) -> DataFrame:
    """One row per row of docs: id, ids (list of int)."""
    model = docs.sparkSession.sparkContext.broadcast(_model(docs.sparkSession, model_path))

    def run(batches):
        e = pieces.encoder(model.value)
        for b in slices(batches):
            ids = [e.encode(t, end) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")


def decoded(coded: DataFrame, id_col: str = "id", ids_col: str = "ids", model_path: str = MODEL) -> DataFrame:
    """One row per row of coded: id, text."""
    model = coded.sparkSession.sparkContext.broadcast(_model(coded.sparkSession, model_path))

    def run(batches):
        e = pieces.encoder(model.value)
        for b in slices(batches):
            texts = [None if x is None else e.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = coded.schema[id_col].dataType.simpleString()
    return coded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string")


def round_trips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """encoded() and decoded() in one pass, with digests of both: id, n_tokens, ids_sha256, decoded_sha256."""
    model = docs.sparkSession.sparkContext.broadcast(_model(docs.sparkSession, model_path))

    def run(batches):
        e = pieces.encoder(model.value)
        hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in slices(batches):
            n, ids_sha, text_sha = [], [], []
            for text in b.column(1).to_pylist():
                ids = e.encode(text)
                n.append(len(ids))
                ids_sha.append(hexed(" ".join(map(e.decimal.__getitem__, ids))))
                text_sha.append(hexed(e.decode(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit."""
    built = _model(docs.sparkSession, model_path)
    shared = docs.sparkSession.sparkContext.broadcast((built, pieces.whole_tokens(built)))

    def run(batches):
        c = pieces.counter(*shared.value)
        for part in slices(batches, 100):
            n = c.counts(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return base.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op5_sentencepiece_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
