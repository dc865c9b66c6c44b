"""Secret scans: three patterns, and strings that a general vocabulary can't write in few tokens.

Text that people write takes about four characters a token; random strings take fewer than about two. Runs of key characters, without
what a span of the patterns covers and without stretches of one character, are reported as `random` if they are long enough and below
a ratio of characters per token (a lower one for letters of one case only, as invented words are). Digests of known lengths,
identifiers of known forms, numbers, and names whose parts are short or cheap in tokens are left out.

One narrow pass, whole texts of any length. Defined results: a null text counts as empty; a text without spans gives empty lists, and
an empty table an empty result. Rows that repeat are handled each on its own. Only the two named columns are read, so others can't
clash. Offsets are code points.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import islice, takewhile

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import digest, documents, file_bytes, ship, slices

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
LEAST_CHARS, CHARS_PER_TOKEN, ONE_KIND_RATIO, SHORT_PART = 20, 2.2, 1.9, 8

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_CHARS},}}")
#: Hex lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}|[0-9A-F]{128})")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Words joined by _ - or /, each with digits only at its end; long numbers with separators.
NAMED = re.compile(r"[_/-]*(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,8})(?:[_/-]+(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,8}))+[_/-]*")
NUMBER = re.compile(r"[0-9/_=+-]+")
RULED = re.compile(r"(.)\1{9,}")


class Scanner:
    def __init__(self, ranks: bytes, pattern: str = public_tokenizers.PATTERN, ratio: float = CHARS_PER_TOKEN):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.vocabulary = tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.ratio = ratio

    def tokens(self, run: str) -> int:
        return len(self.vocabulary.encode_ordinary(run))

    def identifier(self, run: str) -> bool:
        """Digests and identifiers of known forms, numbers, and names of short or cheap parts."""
        if DIGEST.fullmatch(run) or UUID.fullmatch(run) or NUMBER.fullmatch(run):
            return True
        return bool(NAMED.fullmatch(run)) and all(len(x) < SHORT_PART or len(x) >= self.ratio * self.tokens(x) for x in re.split("[_/-]+", run))

    def inefficient(self, run: str) -> bool:
        kinds = sum(bool(re.search(p, run)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
        return len(run) < min(self.ratio, ONE_KIND_RATIO if kinds < 2 else self.ratio) * self.tokens(run)

    def random(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans of random strings; base: the patterns' spans by start."""
        found, at = [], 0
        for m in RUN.finditer(text):
            while at < len(base) and base[at][1] <= m.start():
                at += 1
            gaps = [(s, e) for s, e, _ in takewhile(lambda x: x[0] < m.end(), islice(base, at, None))]  # noqa: B023
            gaps += [x.span() for x in RULED.finditer(text, m.start(), m.end())]
            begin = m.start()
            for s, e in [*sorted(gaps), (m.end(), m.end())]:
                part = text[begin:s]
                if len(part) >= LEAST_CHARS and self.inefficient(part) and not self.identifier(part):
                    found.append((begin, s, 3))
                begin = max(begin, e)
        return found

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind) by start, then kind as listed."""
        if not text:
            return []
        found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
        found.sort()
        found += self.random(text, found)
        found.sort(key=lambda x: (x[0], x[2]))
        return [(s, e, KINDS[k]) for s, e, k in found]


_SCANNERS: dict[str, Scanner] = {}


def scanner(ranks: bytes, ratio: float) -> Scanner:
    key = f"{digest(ranks)}-{ratio}"
    if key not in _SCANNERS:
        _SCANNERS[key] = Scanner(ranks, ratio=ratio)
    return _SCANNERS[key]


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, ratio: float = CHARS_PER_TOKEN) -> DataFrame:
    """One row per row of docs: id, found (array of start, end, kind)."""
    spark = docs.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(file_bytes(spark, vocabulary))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def run(batches):
        s = scanner(ranks.value, ratio)
        for b in slices(batches):
            found = [[{"start": x, "end": y, "kind": k} for x, y, k in s.spans(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(span))], ["id", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, f"id {kind}, found array<struct<start:long,end:long,kind:string>>")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["kind"] != "random")
    return found.select(
        F.col("id").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"),
    )


def spans_digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
