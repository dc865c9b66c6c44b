"""Token files, piece encoding, token counts and secrets against the libraries and by hand."""

import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from groupforge.llm import common, piece_queries, pieces, secrets, token_file

TEXTS = [
    None, "", " ", "  ", "plain words, and more words.", "It's the user's <|endoftext|> don't", "\x00\x01 a", "日本語 テスト 漢字🙂", "a\nb\n\n\nc\t\td", "x" * 3000, "    def f(x):\n        return x_y+1\n", "Straße ÉCOLE ½ ²x",
    "<s> </s> <unk> <0x0A> ▁ ▁▁", "ΟΔΟΣ ΣΑΣ İstanbul ǅ", "é ́x \x1c \x85\xa0 z", "क्षि ನಮ",
]


def random_texts(seed, alphabet, n=400):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(open(piece_queries.MODEL, "rb").read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_queries.MODEL)


def test_piece_encoding_and_decoding(model, library):
    e = pieces.Encoder(model)
    rnd = random.Random(1)
    pool = list(model.ids)
    texts = [t or "" for t in TEXTS] + random_texts(2, "ab cde▁fgh ie  the.,;:é日本🙂\n\t01239²ßΣς_") + ["".join(rnd.choice(pool) for _ in range(rnd.randint(1, 12))) for _ in range(1500)]
    for t in texts:
        ids = e.encode(t)
        assert ids == library.encode(t, add_eos=True), t
        assert e.decode(ids) == library.decode(ids), t


def test_decoding_of_any_ids(model, library):
    e = pieces.Encoder(model)
    rnd = random.Random(4)
    for _ in range(500):
        ids = [rnd.choice([rnd.randrange(1, 32000), rnd.randrange(3, 259)]) for _ in range(rnd.randint(0, 12))]
        assert e.decode(ids) == library.decode(ids), ids


def test_cache_of_bounded_size(model, library):
    e = pieces.Encoder(model, cached=5)
    for t in random_texts(5, "abc def", 100):
        assert e.encode(t, end=False) == library.encode(t)
    assert len(e.cache) <= 5


def test_token_counts(model, library):
    whole = pieces.whole_tokens(model)
    assert all(library.encode(p[1:]) == [model.ids[p]] for p in sorted(whole)[:5000] if p[0] == "▁" and "▁" not in p[1:] and len(p) > 1)
    c = pieces.Counter(model, whole, cached=len(whole) + 20)
    texts = TEXTS + random_texts(6, "the of an. ,é日\n▁")
    for at in range(0, len(texts), 37):
        assert c.counts(texts[at : at + 37]) == [len(library.encode(t or "")) for t in texts[at : at + 37]]


def test_piece_queries_on_rows(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    coded = piece_queries.encoded(docs)
    assert sorted((str(r.id), list(r.ids)) for r in coded.collect()) == sorted((str(i), library.encode(t or "", add_eos=True)) for i, t in rows)
    back = piece_queries.decoded(coded)
    assert sorted((str(r.id), r.text) for r in back.collect()) == sorted((str(i), library.decode(library.encode(t or ""))) for i, t in rows)
    counts = piece_queries.counted(docs, limit=20).collect()
    assert sorted((str(r.id), r.n_bytes, r.n_tokens, r.over_limit) for r in counts) == sorted((str(i), len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 20) for i, t in rows)
    assert piece_queries.counted(docs.limit(0)).count() == piece_queries.round_trips(docs.limit(0)).count() == 0


def test_pieces_with_other_columns_and_a_long_text(spark, library):
    text = "Some words, again and again. " * 20_000
    docs = spark.createDataFrame([(1, text, 5, "x")], "doc_id long, text string, n_tokens long, ids string")
    want = library.encode(text, add_eos=True)
    assert piece_queries.round_trips(docs).first().n_tokens == len(want) and piece_queries.counted(docs).first().n_tokens == len(want) - 1
    assert list(piece_queries.encoded(docs).first().ids) == want


def test_word_encoder_is_the_library():
    e = token_file.WordEncoder(open(token_file.TOKENIZER, "rb").read())
    t = Tokenizer.from_file(token_file.TOKENIZER)
    assert e.words
    texts = [x or "" for x in TEXTS] + random_texts(7, "ab cdE TH.,;:éÉ日🙂\n\t019²ßΣςİǅ'sS\x1c\x85\xa0 ́_-|<>½ªº") + random_texts(8, "abXYZ éÉßÑ.,'s_-~\n\xa0²½ªÿĀŉǅʰ˂0")
    for x in texts:
        assert np.frombuffer(e.encode(x), "<u2").tolist() == t.encode(x, add_special_tokens=False).ids, x


def word_encoder(**more):
    return token_file.WordEncoder(open(token_file.TOKENIZER, "rb").read(), **more)


class Counted:
    """A tokenizer that counts how often it is asked."""

    def __init__(self, of):
        self.of, self.calls, self.model = of, 0, self

    def tokenize(self, part):
        return self._asked(self.of.model.tokenize, part)

    def encode(self, *args, **more):
        return self._asked(self.of.encode, *args, **more)

    def encode_batch_fast(self, *args, **more):
        return self._asked(self.of.encode_batch_fast, *args, **more)

    def _asked(self, f, *args, **more):
        self.calls += 1
        return f(*args, **more)


def test_the_library_merges_new_parts_in_one_call():
    e = word_encoder()
    names = [x for x in ("library", "merges") if hasattr(e, x)]
    for x in names:
        setattr(e, x, Counted(getattr(e, x)))
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(5, 9))) for _ in range(1500)]
    text = " ".join(w + marks for marks in ("", ",", ".!", "***") for w in words)
    want = Tokenizer.from_file(token_file.TOKENIZER).encode(text, add_special_tokens=False).ids
    for _ in range(2):  # the second time, all of it is cached
        assert np.frombuffer(e.encode(text), "<u2").tolist() == want
        assert sum(getattr(e, x).calls for x in names) == 1


@pytest.mark.parametrize("how", ["cached", "small cache", "part by part"])
def test_texts_of_a_batch(how):
    e, t = word_encoder(**({"cached": 7} if how == "small cache" else {})), Tokenizer.from_file(token_file.TOKENIZER)
    assert e.last is not None
    if how == "part by part":
        e.last = None
    texts = [None, *TEXTS, *random_texts(9, "abé.,'s!$_- \n\t²0", 300), *random_texts(10, "ab,日\u0301 ", 60), "</w> <|endoftext|> x", "it's!' don't'' 's's", "w" * 70 + "," + " w" * 9]
    random.Random(3).shuffle(texts)
    for at in range(0, len(texts), 40):
        column = pa.array(texts)[at : at + 40]  # a slice, whose buffers hold more
        got = e.encode_all(column, b"\x02\x00")
        assert [np.frombuffer(x.as_py(), "<u2").tolist() for x in got] == [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in column.to_pylist()]
        assert token_file.all_ids(got[3:9], 2).tolist() == [i for x in got[3:9] for i in np.frombuffer(x.as_py(), "<u2").tolist()]
    assert not any(len(p) > 64 for p in [*e.parts, *e.older])
    if how == "small cache":
        assert len(e.older) < len(set(" ".join(x or "" for x in texts).split()))
    assert len(e.encode_all(pa.array([], pa.string()))) == 0


def test_characters_of_plain_texts():
    e, t = word_encoder(), Tokenizer.from_file(token_file.TOKENIZER)
    for x in [form.format(chr(c)) for c in range(0x300) if chr(c) not in "\x1c\x1d\x1e\x1f\u0130" for form in ("{}", "ab{}", "{}ab", "a{}b,")]:
        assert e._plain(x) and np.frombuffer(e.encode(x), "<u2").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_batches_by_bytes():
    texts = [None, "a" * 10, "é" * 5, "", "b" * 50, "c", None, "d" * 19, "e"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], ["id", "text"])
    parts = [b.column(1).to_pylist() for b in token_file.by_bytes([batch], 20)]
    assert [x for p in parts for x in p] == texts
    assert [len(p) for p in parts] == [4, 1, 4 - 1, 1] and list(token_file.by_bytes([batch.slice(0, 0)], 20)) == []


def test_counts_are_apart_from_ids(spark, tmp_path):
    coded = token_file.token_ids(spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string"), counted=True)
    coded.write.parquet(str(tmp_path / "ids"))
    scan = spark.read.parquet(str(tmp_path / "ids")).select("counts").where("counts IS NOT NULL")
    assert "ReadSchema: struct<counts:binary>" in scan._jdf.queryExecution().toString()
    total = sum(np.frombuffer(r.counts, np.int64) for r in scan.collect())
    ids = [*Tokenizer.from_file(token_file.TOKENIZER).encode("some words", add_special_tokens=False).ids, 2, 2]
    assert total.tolist() == np.bincount(ids, minlength=len(total)).tolist()


def test_other_tokenizers_go_through_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    e = token_file.WordEncoder(open(path, "rb").read())
    assert not e.words
    assert np.frombuffer(e.encode("Hello  world"), "<u2").tolist() == Tokenizer.from_file(path).encode("Hello  world", add_special_tokens=False).ids


def huffman_bits(counts):
    heap = [(c, 0) for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[0], heapq.heappop(heap)[0]
        total += a + b
        heapq.heappush(heap, (a + b, 0))
    return total


@pytest.mark.parametrize("seed", range(4))
def test_code_lengths(seed):
    rnd = np.random.default_rng(seed)
    counts = (rnd.pareto(0.7, 300) * 5).astype(np.int64)
    free = token_file.code_lengths(counts, 40)
    assert (counts * free).sum() == huffman_bits(counts.tolist())
    tight = token_file.code_lengths(counts, 9)
    used = tight[counts > 0].astype(float)
    assert used.max() <= 9 and abs((0.5**used).sum() - 1) < 1e-12 and (tight[counts == 0] == 0).all()


@pytest.mark.parametrize("n", [0, 1, 5, 127, 128, 129, 5000])
def test_code_round_trip(n):
    rnd = np.random.default_rng(n)
    ids = np.minimum((rnd.pareto(1.0, n) * 3).astype(np.int64), 999)
    code = token_file.Code(token_file.code_lengths(np.bincount(ids, minlength=1000), 12), 12)
    bits, offsets = code.encode(ids)
    assert code.decode(bits, offsets, n).tolist() == ids.tolist()


def test_too_many_ids_for_the_code():
    with pytest.raises(ValueError, match="bits"):
        token_file.code_lengths(np.ones(9, dtype=np.int64), 3)


@pytest.mark.parametrize("block", [1, 50, 1 << 17])
def test_token_file(spark, tmp_path, block):
    rows = list(enumerate(TEXTS))[::-1] + [(-4, "first of all"), (None, "no id"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    token_file.write(docs, str(tmp_path / "f"), block_tokens=block, step=8)
    t = Tokenizer.from_file(token_file.TOKENIZER)
    ids = {(str(i), x): [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in rows}
    got = token_file.read(spark, str(tmp_path / "f")).collect()
    assert sorted((str(r.id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted((k[0], v) for k, v in ids.items())
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.id for r in ordered] == [None, -4, *sorted([*range(len(TEXTS)), 7])]
    at = 0
    for r in ordered:
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and zlib.crc32(r.ids) == token_file.crc32(np.frombuffer(r.ids, "<u4").tolist())
        at += r.n_tokens


def test_token_file_with_other_columns_and_a_long_text(spark, tmp_path):
    rows = [(2, "word " * 100_000, 1, "x"), (1, "short", 2, "y")]
    token_file.write(spark.createDataFrame(rows, "doc_id long, text string, n long, ids string"), str(tmp_path / "f"))
    assert sorted((r.id, r.start, r.n_tokens) for r in token_file.read(spark, str(tmp_path / "f")).collect())[0][:2] == (1, 0)
    assert token_file.read(spark, str(tmp_path / "f")).where("id = 2").first().n_tokens >= 100_001


def test_empty_token_file(spark, tmp_path):
    token_file.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "f"))
    assert token_file.read(spark, str(tmp_path / "f")).count() == 0


# --- secrets

RANDOM = "q7Zp0Vx2Lk9Tb4Wn8Rf3Hs6Jd1"


@pytest.fixture(scope="module")
def scan():
    return secrets.Scanner(open(secrets.VOCABULARY, "rb").read())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []), ("", []), ("nothing to see", []), ('token = "abcdefghijkl"', [(0, 21, "assign")]), ("token: short", []), ("password=secret:abcdefghijklmnop", []),
        ("API_KEY='ABCDEFGHIJKL' x", [(0, 21, "assign")]), ("AKIA" + "B" * 14, [(0, 18, "access")]), ("AKIA" + "B" * 13, []), ("é 0123456789abcdef!", [(2, 18, "hex")]), ("0123456789abcde", []),
        ("paſſword=abcdefghijklmnop", []), (f"see {RANDOM}.", [(4, 4 + len(RANDOM), "random")]), ("token=0123456789abcdef", [(0, 22, "assign"), (6, 22, "hex")]),
        ("the 550E8400-E29B-41D4-A716-446655440000 id", []), ("D41D8CD98F00B204E9800998ECF8427E", []), ("some_long_identifier_name_v2", []), ("=" * 30 + "aA1", []), ("internationalisationally", []), ("1234567890123456789012", [(0, 22, "hex")]),
    ],
)
def test_spans(scan, text, want):
    assert scan.spans(text) == want


def test_random_runs_are_inefficient(scan):
    assert len(RANDOM) < secrets.CHARS_PER_TOKEN * scan.tokens(RANDOM)
    words = "InternationalStandardOrganisationNumber"
    assert len(words) > secrets.CHARS_PER_TOKEN * scan.tokens(words)
    assert scan.spans(f"x {RANDOM * 4000} y") == [(2, 2 + 4000 * len(RANDOM), "random")]
    assert scan.spans("A" * 30 + f"/{RANDOM}==========") == [(30, 31 + len(RANDOM), "random")]  # a key with padding, after a rule
    assert scan.spans(f"{RANDOM}_0123456789abcdef0123") == [(0, len(RANDOM) + 1, "random"), (len(RANDOM) + 1, len(RANDOM) + 21, "hex")]
    rnd = random.Random(3)
    letters = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(32)) for _ in range(200)]
    assert sum(scan.spans(x) == [(0, 32, "random")] for x in letters) > 170
    assert scan.spans("sk_live_" + "".join(rnd.choice("abcdefghijkLMNOPQRSTUVWXYZ") for _ in range(28)))[0][2] == "random"


def spans_by_hand(text):
    """The three patterns without regular expressions, by their text: kind, start and end, in order."""
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

    def run(at, allowed):
        while at < len(text) and text[at] in allowed:
            at += 1
        return at

    def assign(at):
        for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            if "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text[at : at + len(word)]) == word:
                end = at + len(word)
                end += text[end : end + 1] in ("'", '"')
                end = run(end, " ")
                if text[end : end + 1] in (":", "="):
                    end = run(end + 1, " ")
                    end += text[end : end + 1] in ("'", '"')
                    stop = run(end, value)
                    if stop > end:
                        return stop, stop - end >= 12
        return None

    def access(at):
        if text[at : at + 4] == "AKIA" and (end := run(at + 4, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))) > at + 4:
            return end, end - at >= 18
        return None

    def hexed(at):
        end = run(at, set("0123456789abcdef"))
        return (end, end - at >= 16) if end > at else None

    found = []
    for order, (kind, match) in enumerate((("assign", assign), ("access", access), ("hex", hexed))):
        at = 0
        while at < len(text):
            if m := match(at):
                if m[1]:
                    found.append((at, order, m[0], kind))
                at = m[0]
            else:
                at += 1
    return [(s, e, k) for s, _, e, k in sorted(found)]


@pytest.mark.parametrize("seed", range(4))
def test_patterns_against_a_scanner_by_hand(scan, seed):
    rnd = random.Random(seed)
    pieces_ = ["password", "PassWd", "secret", "token", "API_KEY", "apikey", '"', "'", " ", "  ", ":", "=", "AKIA", "abcdef0123456789", "ABCDEFGHIJKLMN0", "deadbeef", "x", "é", "\n", "+/_.-", "0" * 9, "Zq9"]
    found = 0
    for _ in range(3000):
        text = "".join(rnd.choice(pieces_) for _ in range(rnd.randint(1, 14)))
        want = spans_by_hand(text)
        assert [x for x in scan.spans(text) if x[2] != "random"] == want, text
        found += len(want)
    assert found > 500


def test_no_secrets_in_an_empty_table(spark):
    assert secrets.scanned(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_secret_rows(spark, tmp_path):
    rows = [(1, f"k {RANDOM}", 5), (2, None, 6), (2, "token=abcdefghijklmn", 6)]
    spark.createDataFrame(rows, "doc_id long, text string, spans long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.n_assign): (r.base_sha256, r.spans) for r in secrets.op6_secret_scan(spark, str(tmp_path)).collect()}
    none = secrets.spans_digest([])
    assert got == {(1, 0): (none, f"random:2:{2 + len(RANDOM)}"), (2, 0): (none, ""), (2, 1): (secrets.spans_digest([(0, 20, "assign")]), "assign:0:20")}


def test_scratch_uses_the_named_folder(spark):
    assert common.scratch_dir(spark).startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
