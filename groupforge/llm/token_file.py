"""Token ids in a compressed block format: canonical length-limited Huffman codes from global counts.

Format (a folder): `codebook` holds one row: max_bits, end_id, and the code length of each id, which fixes the canonical codes
(by length, then id; most significant bit first). `blocks` holds rows of whole documents in ascending doc_id order, about
BLOCK_TOKENS tokens each: doc_ids, doc_tokens, the bits, and the bit offset of every STEP-th token. A block decodes alone; its
checkpoints decode side by side, one table lookup a token and checkpoint. Part and place order the blocks; part files hold
them in that order.

Encoding, which counts ids on its way, and coding are separate passes over written tables: a lost executor repeats its tasks
only. The driver gets one row per vocabulary entry and one per part file. The range partitions by doc_id are as many as shuffle
partitions.

Defined results: a null text counts as empty and holds the end id only; null ids come first; rows that repeat are documents of
their own. A very long text is one block; memory is bounded by one document plus one block plus Spark's bound of Arrow batches in
bytes. Only the two named columns are read, so others can't clash. An empty table gives an empty folder and result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Recent, Scratch, digest, documents, file_bytes, ship, slices

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID, MAX_BITS, BLOCK_TOKENS, STEP = 2, 20, 1 << 17, 128


# --- text to ids


class WordEncoder:
    """The tokenizers library behind caches of pre-tokens, for files whose texts split at white space; else the library alone.

    Texts are cut at white space. Distinct words of plain texts (characters below U+0300, where lower-casing is by character and NFC
    changes nothing) are cut by the file's own pattern, and each part is merged; words of other texts go through the whole library.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, spec: bytes, cached: int = 500_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec.decode())
        self.library.no_truncation()
        self.library.no_padding()
        data = json.loads(spec)
        self.kind = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.words = self._splits_at_spaces(data)
        if self.words:
            special = "|".join(re.escape(x["content"]) for x in data["added_tokens"]) or r"(?!)"
            self.odd = re.compile(rf"[\x1c-\x1f\u0130\u0300-\U0010ffff]|{special}").search
            self.marks = ["\x1c", "\x1d", "\x1e", "\x1f", *(x["content"] for x in data["added_tokens"])]
            self.find = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w]|_)+").findall
            self.spaced = re.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+").findall
            printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
            rest = iter(range(256, 512))
            self.shown = [chr(b) if b in set(printable) else chr(next(rest)) for b in range(256)]
            self.cached, self.parts, self.older = cached, {"": b""}, {}
            self.any_words = Recent(self._word, 200_000)
            self.merges = Tokenizer.from_str(json.dumps(data | {"normalizer": None, "pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": " "}, "post_processor": None, "added_tokens": [], "truncation": None, "padding": None}))
            # the last id of a part shows, where the file marks ends of words and knows every byte
            suffix, vocab = data["model"].get("end_of_word_suffix"), data["model"]["vocab"]
            self.last = None
            if suffix and all(c in vocab and c + suffix in vocab for c in self.shown):
                self.last = np.zeros(max(vocab.values()) + 1, dtype=bool)
                self.last[[i for token, i in vocab.items() if token.endswith(suffix)]] = True

    def _splits_at_spaces(self, data: dict) -> bool:
        """Whether the file is of the kind the caches are right for."""
        norm, pre, model = data.get("normalizer") or {}, data.get("pre_tokenizer") or {}, data["model"]
        norms = [(x["type"], x.get("pattern"), x.get("content")) for x in norm.get("normalizers", [])]
        pres = [(x["type"], x.get("pattern"), x.get("behavior"), x.get("invert"), x.get("use_regex"), x.get("add_prefix_space")) for x in pre.get("pretokenizers", [])]
        return (
            norms == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
            and pres == [("Split", {"Regex": self.PATTERN}, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)]
            and model["type"] == "BPE"
            and not model.get("dropout")
            and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or re.search(r"\s", x["content"]) for x in data["added_tokens"])
        )

    def _merge(self, parts: list[str], at_once: int = 1 << 14) -> list[bytes]:
        """Ids of each part. The library merges many in a call; where ends don't show, one by one."""
        size, out = array(self.kind).itemsize, []
        for at in range(0, len(parts), at_once):
            some = [p if p.isascii() and p.isprintable() else "".join([self.shown[b] for b in p.encode()]) for p in parts[at : at + at_once]]
            if self.last is not None:
                ids = np.array(self.merges.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype=f"<u{size}")
                ends = (np.flatnonzero(self.last[ids]) + 1) * size
                if len(ends) == len(some):
                    data, ends = ids.tobytes(), ends.tolist()
                    out += [data[x:y] for x, y in zip([0, *ends], ends, strict=False)]
                    continue
            out += [array(self.kind, [t.id for t in self.merges.model.tokenize(p)]).tobytes() for p in some]
        return out

    def _ids(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts. Parts in use stay cached: the younger of two caches holds what was asked for last."""
        if len(self.parts) >= self.cached:
            self.parts, self.older = {"": b""}, self.parts
        found = list(map(self.parts.get, parts))
        left = [i for i, x in enumerate(found) if x is None]
        new = []
        for i in left:
            found[i] = self.older.get(parts[i])
            if found[i] is None:
                new.append(i)
        for i, x in zip(new, self._merge([parts[i] for i in new]), strict=True):
            found[i] = x
        self.parts.update((parts[i], found[i]) for i in left if len(parts[i]) <= 64)
        return found

    def _plain_words(self, words: pa.Array) -> pa.Array:
        """Ids of distinct lower-cased words of plain texts. Letters with marks behind them are two parts, others are cut by the pattern."""
        letters = pc.ascii_rtrim(words, characters=self.MARKS)
        two = pc.utf8_is_alpha(letters)
        cut = list(map(self.find, strings(words.filter(pc.invert(two)))))
        words, letters = words.filter(two), letters.filter(two)
        bounds, n = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset :], len(words)
        start = bounds[:n] + pc.binary_length(letters).to_numpy()
        sizes = bounds[1 : n + 1] - start
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        at = np.repeat(start - ends[:-1], sizes) + np.arange(ends[-1], dtype=np.int32)
        data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[at]
        marks = pa.StringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(data))
        parts = pa.concat_arrays([letters, marks, pa.array(list(chain.from_iterable(cut)), pa.string())]).dictionary_encode()
        of, ids = parts.indices, pa.array(self._ids(strings(parts.dictionary)), pa.binary())
        coded = pc.binary_join_element_wise(ids.take(of[:n]), ids.take(of[n : 2 * n]), b"")
        if not cut:
            return coded
        others = joined(ids.take(of[2 * n :]), np.cumsum([0, *map(len, cut)]))
        two = two.to_numpy(zero_copy_only=False)
        place = np.argsort(np.concatenate([np.flatnonzero(two), np.flatnonzero(~two)]))
        return pa.concat_arrays([coded, others]).take(pa.array(place))

    def _word(self, word: str) -> bytes:
        return array(self.kind, self.library.encode(word, add_special_tokens=False).ids).tobytes()

    def _plain_texts(self, texts: pa.Array, end: bytes) -> pa.Array:
        words = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        coded = words.flatten().dictionary_encode()
        ids = pa.concat_arrays([self._plain_words(coded.dictionary), pa.array([end], pa.binary())])
        at = words.offsets.to_numpy()
        taken = np.insert(coded.indices.to_numpy(), at[1:], len(ids) - 1)
        return joined(ids.take(pa.array(taken)), at + np.arange(len(at), dtype=np.int32))

    def encode_all(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """Each text's ids as little-endian unsigned integers of 16 bits, or 32 for large vocabularies, with `end` after them; null is empty."""
        texts = texts.cast(pa.string()).fill_null("")
        as_str = texts.to_pylist()
        plain = np.array([self.words and self._plain(x) for x in as_str], dtype=bool)
        if plain.all():
            return self._plain_texts(texts, end) if as_str else pa.array([], pa.binary())
        other = np.flatnonzero(~plain)
        coded = pa.array([self._other(as_str[i]) + end for i in other], pa.binary())
        if not plain.any():
            return coded
        place = np.argsort(np.concatenate([np.flatnonzero(plain), other]))
        return pa.concat_arrays([self._plain_texts(texts.filter(pa.array(plain)), end), coded]).take(pa.array(place))

    def _other(self, text: str) -> bytes:
        if not self.words:
            return self._word(text) if text else b""
        return b"".join(map(self.any_words.__getitem__, self.spaced(text)))

    def encode(self, text: str | None) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].as_py()

    def _plain(self, text: str) -> bool:
        try:
            text.encode("latin-1")  # far faster than a search, where it says yes
        except UnicodeEncodeError:
            return not self.odd(text)
        return not any(x in text for x in self.marks)


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(spec: bytes) -> WordEncoder:
    key = digest(spec)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(spec)
    return _ENCODERS[key]


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, counted: bool = False) -> DataFrame:
    """One row per row of docs: id (long), n, ids (binary, as WordEncoder gives them, with the end id).

    counted: each task adds one row with n = -1 and a column `counts` that is null elsewhere: the task's number of each id, as 64-bit integers.
    """
    spark = docs.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(file_bytes(spark, tokenizer))
    more = [("counts", pa.binary())] if counted else []
    names = ["id", "n", "ids", *(c for c, _ in more)]

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core's work
        e = word_encoder(spec.value)
        end = array(e.kind, [end_id]).tobytes()
        total = np.zeros(max(e.library.get_vocab_size(), end_id + 1), dtype=np.int64)
        for b in by_bytes(batches):
            ids = e.encode_all(b.column(1), end)
            n = pc.divide(pc.binary_length(ids), len(end)).cast(pa.int64())
            if counted:
                total += np.bincount(all_ids(ids, len(end)), minlength=len(total))
            yield pa.RecordBatch.from_arrays([b.column(0), n, ids, *(pa.nulls(len(ids), t) for _, t in more)], names)
        if counted and total.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.array([b""], pa.binary()), pa.array([total.tobytes()], pa.binary())], names)

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, "id long, n long, ids binary" + ", counts binary" * counted)


def strings(column: pa.Array) -> list[str]:
    """A column of strings without nulls and spaces as a list, far faster than to_pylist."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(column)], column), " ")[0].as_py().split(" ") if len(column) else []


def joined(column: pa.Array, at: np.ndarray) -> pa.Array:
    """What a binary column without nulls holds between the rows `at`, the first of them 0."""
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset :][at] if len(column) else np.zeros(len(at), dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(bounds.tobytes()), column.buffers()[2]])


def by_bytes(batches, most: int = 1 << 23):
    """Arrow batches in parts of at most so many bytes in their second column, or one row, as words take several times a text's room."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, upto - at)
            at = upto


def all_ids(ids: pa.Array, width: int) -> np.ndarray:
    """The ids of all rows of a binary column without nulls, from its one buffer."""
    _, bounds, data = ids.buffers()
    bounds = np.frombuffer(bounds, dtype=np.int32)[ids.offset : ids.offset + len(ids) + 1]
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]].view(f"<u{width}")


# --- codes


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Best code lengths of at most max_bits for the ids that occur, 0 for the others (package-merge, Larmore and Hirschberg).

    What a level takes is a prefix of its sorted list, so only how many of them are single ids is needed.
    """
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids don't fit into codes of {max_bits} bits")
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    n, packages, singles = len(order), np.zeros(0), []
    for _ in range(max_bits):
        both = np.concatenate([weights, packages])
        at = np.argsort(both, kind="stable")
        singles.append(np.concatenate([[0], np.cumsum(at < n)]))
        both = both[at][: len(at) // 2 * 2]
        packages = both[0::2] + both[1::2]
    take, own = 2 * n - 2, np.zeros(n, dtype=np.uint8)
    for upto in reversed(singles):
        own[: upto[take]] += 1
        take = 2 * (take - int(upto[take]))
    lengths[order] = own
    return lengths


class Code:
    """Canonical codes and the decoding table of given code lengths."""

    def __init__(self, lengths: np.ndarray, max_bits: int = MAX_BITS):
        lengths = np.asarray(lengths, dtype=np.int64)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        own = lengths[order]
        spans = 1 << (max_bits - own)
        starts = np.concatenate([[0], np.cumsum(spans)[:-1]]) if len(order) else np.zeros(0, dtype=np.int64)
        self.max_bits, self.lengths = max_bits, lengths
        self.codes = np.zeros(len(lengths), dtype=np.uint64)
        self.codes[order] = (starts >> (max_bits - own)).astype(np.uint64)
        self.id_of = np.zeros(1 << max_bits, dtype=np.uint32)
        self.bits_of = np.zeros(1 << max_bits, dtype=np.uint8)
        filled = int(spans.sum())
        self.id_of[:filled] = np.repeat(order.astype(np.uint32), spans)
        self.bits_of[:filled] = np.repeat(own.astype(np.uint8), spans)

    def encode(self, ids: np.ndarray, step: int = STEP) -> tuple[bytes, np.ndarray]:
        """The bits, and the bit offset of every step-th id."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        at = ends - size
        word, off = at >> 5, at & 31
        value = self.codes[ids] << (64 - size - off).astype(np.uint64)
        n = int(ends[-1] + 31 >> 5) + 1 if len(ids) else 1
        high = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n)
        low = np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)[:n]
        total = (high + low).astype(np.uint64).astype(">u4").tobytes()
        return total[: int(ends[-1] + 7 >> 3) if len(ids) else 0], at[::step].astype(np.uint32)

    def decode(self, bits: bytes, offsets: np.ndarray, n: int, step: int = STEP) -> np.ndarray:
        """n ids; all checkpoints advance together."""
        lanes = len(offsets)
        raw = np.frombuffer(bits + bytes(8), dtype=np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        at, out = offsets.astype(np.int64), np.zeros((step, lanes), dtype=np.uint32)
        mask, room = np.uint32((1 << self.max_bits) - 1), 32 - self.max_bits
        last = len(window) - 1
        for k in range(step):
            got = window[np.minimum(at >> 3, last)] >> (room - (at & 7)).astype(np.uint32) & mask
            out[k] = self.id_of[got]
            at += self.bits_of[got]
        return out.T.reshape(-1)[:n]


# --- files


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, max_bits: int = MAX_BITS, block_tokens: int = BLOCK_TOKENS, step: int = STEP) -> None:
    """Writes the format's folder from the texts of docs."""
    if max_bits > 24:
        raise ValueError("decoding reads codes of at most 24 bits")
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    vocabulary = word_encoder(file_bytes(spark, tokenizer)).library.get_vocab_size()
    width = 2 if vocabulary <= 1 << 16 else 4
    size = max(vocabulary, end_id + 1)
    coded = scratch.stage(token_ids(docs, id_col, text_col, tokenizer, end_id, counted=True), "ids")
    ids = coded.where("n >= 0").drop("counts")

    def add(batches):
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_buffer(), dtype=np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["token", "n"])

    counts = np.zeros(size, dtype=np.int64)
    for r in coded.select("counts").where("counts IS NOT NULL").mapInArrow(add, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        counts[r["token"]] = r["n"]
    lengths = code_lengths(counts, max_bits)
    shared = spark.sparkContext.broadcast(lengths)

    def blocks(batches):
        code, part = Code(shared.value, max_bits), TaskContext.get().partitionId()
        start, place, held, ids_, sizes = 0, 0, 0, [], []
        names = ["part", "place", "start", "n_tokens", "doc_ids", "doc_tokens", "bits", "offsets"]

        def row():
            nonlocal start, place, held, ids_, sizes
            all_ids = np.frombuffer(b"".join(ids_), dtype=f"<u{width}")
            bits, offsets = code.encode(all_ids, step)
            docs_, n = [s[0] for s in sizes], [s[1] for s in sizes]
            columns = [pa.array([x], t) for x, t in ((part, pa.int32()), (place, pa.int64()), (start, pa.int64()), (len(all_ids), pa.int64()), (docs_, pa.list_(pa.int64())), (n, pa.list_(pa.int64())), (bits, pa.binary()), (offsets.astype("<u4").tobytes(), pa.binary()))]
            start, place, held, ids_, sizes = start + len(all_ids), place + 1, 0, [], []
            return pa.RecordBatch.from_arrays(columns, names)

        for b in batches:
            for doc, n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids_.append(data.as_buffer().to_pybytes())
                sizes.append((doc, n))
                held += n
                if held >= block_tokens:
                    yield row()
        if sizes:
            yield row()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ids.repartitionByRange(parts, F.asc_nulls_first("id")).sortWithinPartitions(F.asc_nulls_first("id"))
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    book = [(max_bits, step, end_id, lengths.tolist())]
    spark.createDataFrame(book, BOOK_SCHEMA).coalesce(1).write.parquet(f"{folder}/codebook")
    scratch.drop(coded)


BLOCK_SCHEMA = "part int, place long, start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, bits binary, offsets binary"
BOOK_SCHEMA = "max_bits int, step int, end_id int, lengths array<int>"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the folder: id, start (ids before it), n_tokens, ids (binary, 32 bits each)."""
    ship(spark)
    book = spark.read.schema(BOOK_SCHEMA).parquet(f"{folder}/codebook").first()
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{folder}/blocks")
    before, total = {}, 0
    for r in sorted(blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        before[r["part"]] = total
        total += r["n"]
    shared = spark.sparkContext.broadcast((np.array(book["lengths"]), before))

    def run(batches):
        code, starts = Code(shared.value[0], book["max_bits"]), shared.value[1]
        for b in slices(batches, 1):
            for r in b.to_pylist():
                ids = code.decode(r["bits"], np.frombuffer(r["offsets"], dtype="<u4"), r["n_tokens"], book["step"]).astype("<u4")
                ends = np.cumsum(r["doc_tokens"])
                begins = ends - np.array(r["doc_tokens"], dtype=np.int64)
                data = [ids[x:y].tobytes() for x, y in zip(begins, ends, strict=True)]
                first = starts[r["part"]] + r["start"]
                columns = [pa.array(r["doc_ids"], pa.int64()), pa.array(begins + first, pa.int64()), pa.array(r["doc_tokens"], pa.int64()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(run, "id long, start long, n_tokens long, ids binary")


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "token-file").path("folder")
    write(documents(spark, sf_dir), folder)
    return read(spark, folder).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
