"""Chat formatting: whole conversations as one text with a loss mask on the assistant's tokens, and the way back.

A conversation is rendered whole by a template, encoded once with offsets, and the sorted spans of its turns are met with the token
spans by binary search. The template's control strings are special tokens, so no token crosses the edge of a turn. Where roles or texts
hold a control string themselves, a backslash goes in after its first character (one more where backslashes are there already), so
that none is left outside the template and every text can be had back.

Rows meet by a shuffle on the conversation and stream in order through a task, which holds one conversation at a time: it is one cell
of the result, so it can't be split; there is no other bound on its length.

Defined results: null roles and texts count as empty; turns go by number, null last, then role, then text, and rows that repeat are
turns of their own; rows with a null conversation are one conversation. A text of any length is kept whole. Only the named columns are
read, so others can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import digest, file_bytes, ship, slices

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
FLUSH_ROWS, FLUSH_CHARS = 64, 1 << 22


@dataclass(frozen=True)
class Template:
    """begin, then for each turn: open, role, text_mark, text, close. reserved: more strings that no text may show as they are.

    A control string's first character (< or [) must be in none of them again, so that no string can arise over an edge.
    """

    begin: str = "<s>"
    open: str = "[INST]"
    text_mark: str = "[/INST]"
    close: str = "</s>"
    reserved: tuple[str, ...] = ("<|endoftext|>",)
    learnt: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        strings = [*self.marks, *self.reserved]
        if any(len(s) < 2 or any(s[0] in t[1:] for t in strings) for s in strings):
            raise ValueError("the first character of a control string can't stand within one")

    @property
    def marks(self) -> tuple[str, ...]:
        return (self.begin, self.open, self.text_mark, self.close)

    def _pattern(self, before: str) -> re.Pattern:
        return re.compile("|".join(f"(?<={re.escape(s[0])}){before}(?=\\\\*{re.escape(s[1:])})" for s in sorted({*self.marks, *self.reserved})))

    def escaped(self, text: str) -> str:
        return self._pattern("").sub(r"\\", text)

    def unescaped(self, text: str) -> str:
        return self._pattern(r"\\").sub("", text)

    def rendered(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The conversation, and where each turn's text is in it."""
        parts, spans, at = [self.begin], [], len(self.begin)
        for role, text in turns:
            head, body = f"{self.open}{self.escaped(role)}{self.text_mark}", self.escaped(text)
            parts += [head, body, self.close]
            spans.append((at + len(head), at + len(head) + len(body)))
            at += len(head) + len(body) + len(self.close)
        return "".join(parts), spans

    def parsed(self, formatted: str) -> list[tuple[str, str]]:
        """Roles and texts of a rendered conversation."""
        turns = []
        for turn in formatted[len(self.begin) :].split(self.close)[:-1]:
            role, text = turn[len(self.open) :].split(self.text_mark, 1)
            turns.append((self.unescaped(role), self.unescaped(text)))
        return turns


PLAIN = Template()


class Coder:
    """A tokenizer whose special tokens include the template's control strings."""

    def __init__(self, spec: bytes, template: Template):
        from tokenizers import AddedToken, Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core's work
        self.template = template
        self.library = Tokenizer.from_str(spec.decode())
        self.library.no_truncation()
        self.library.no_padding()
        self.library.add_special_tokens([AddedToken(s, normalized=False, special=True) for s in template.marks])

    def formatted(self, turns: list[tuple[str, str]]) -> tuple[str, list[int], np.ndarray]:
        """The text, its ids, and for each whether it counts in the loss."""
        text, spans = self.template.rendered(turns)
        coded = self.library.encode(text, add_special_tokens=False)
        offsets = np.array(coded.offsets, dtype=np.int64).reshape(-1, 2)
        loss = np.zeros(len(offsets), dtype=bool)
        for (role, _), (start, end) in zip(turns, spans, strict=True):
            if role in self.template.learnt and start < end:
                # the first token that ends behind the turn's start, and the first that starts at or behind its end
                loss[np.searchsorted(offsets[:, 1], start, "right") : np.searchsorted(offsets[:, 0], end, "left")] = True
        return text, coded.ids, loss

    def learnt(self, ids: list[int], loss: list[bool]) -> list[str]:
        """Texts under the mask, one for each stretch of it, as they were before escaping."""
        out, at = [], 0
        for on, stretch in groupby(loss):
            n = sum(1 for _ in stretch)
            if on:
                out.append(self.template.unescaped(self.library.decode(ids[at : at + n], skip_special_tokens=False)))
            at += n
        return out


_CODERS: dict[tuple, Coder] = {}


def coder(spec: bytes, template: Template) -> Coder:
    key = (digest(spec), template)
    if key not in _CODERS:
        _CODERS[key] = Coder(spec, template)
    return _CODERS[key]


def formatted(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = PLAIN, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per conversation: conv_id, formatted, ids, loss (one for each id)."""
    spark = rows.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(file_bytes(spark, tokenizer))

    def run(batches):
        c = coder(spec.value, template)
        turns: list[tuple[str, str]] = []
        at, out = None, []

        def flushed():
            convs, texts, ids, loss = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(convs, conv_type), pa.array(texts), pa.array(ids, pa.list_(pa.int32())), pa.array(loss, pa.list_(pa.bool_()))], ["conv_id", "formatted", "ids", "loss"])

        for b in slices(batches, 2000):
            conv_type = b.schema.field(0).type
            for conv, said, new in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if new:
                    if turns:
                        out.append((at, *c.formatted(turns)))
                    turns, at = [], conv
                    if len(out) >= FLUSH_ROWS or sum(len(x[1]) for x in out) >= FLUSH_CHARS:
                        yield flushed()
                turns.append((said["role"], said["text"]))
        if turns:
            out.append((at, *c.formatted(turns)))
            yield flushed()

    kind = rows.schema[conv_col].dataType.simpleString()
    said = F.struct(F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), said.alias("said"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "said.role", "said.text")
    dealt = base.select("conv_id", "said", (F.row_number().over(order) == 1).alias("first"))
    return dealt.mapInArrow(run, f"conv_id {kind}, formatted string, ids array<int>, loss array<boolean>")


def read_back(conversations: DataFrame, template: Template = PLAIN, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per row of formatted(): conv_id, turns (role, text) from the formatted text, learnt (texts from the ids under the mask), formatted_chars."""
    spark = conversations.sparkSession
    spec = spark.sparkContext.broadcast(file_bytes(spark, tokenizer))
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])

    def run(batches):
        c = coder(spec.value, template)
        for b in slices(batches, 500):
            texts = b.column(1).to_pylist()
            turns = [[{"role": r, "text": t} for r, t in c.template.parsed(x)] for x in texts]
            learnt = [c.learnt(i, on) for i, on in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(turns, pa.list_(turn)), pa.array(learnt, pa.list_(pa.string())), pa.array([len(x) for x in texts], pa.int64())], ["conv_id", "turns", "learnt", "formatted_chars"])

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return conversations.select("conv_id", "formatted", "ids", "loss").mapInArrow(run, f"conv_id {kind}, turns array<struct<role:string,text:string>>, learnt array<string>, formatted_chars long")


#: A conversation of control strings alone, which the query adds: it is read back as it went in.
HARD = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = spark.range(len(HARD)).select(*[F.element_at(F.array(*[F.lit(r[k]) for r in HARD]), F.col("id").cast("int") + 1).cast(rows.schema[c].dataType).alias(c) for k, c in enumerate(rows.columns)])
    found = read_back(formatted(rows.unionByName(hard)))
    shown = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return found.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(shown.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


_CONTROL = r"<\\*(s|/s|\|endoftext\|)>|\[\\*/?INST\]"
OP13_SQL = rf"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, length(role) + length(text) + len(regexp_extract_all(role, '{_CONTROL}')) + len(regexp_extract_all(text, '{_CONTROL}')) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (3 + sum(17 + chars))::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
