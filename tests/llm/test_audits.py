"""Filter interactions, source divergence and chat formatting, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from groupforge.llm import chat_format, divergence, filter_audit

DOCS = "doc_id long, text string, lang string, source string, id string, mask int, n long"


def table(spark, rows):
    """Documents with more columns, whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, "x", 1, 2) for i, t, lang, s in rows], DOCS)


def hard_documents(seed=3, n=160):
    rnd = random.Random(seed)
    words = ["alpha", "Beta", "ÉTÉ", "été", "gamma", "x", "straße", "DELTA", "日本", "it's", "a1b", "\x85", "tab bed", "100%", "|"]
    texts = [None, "", " \t\n", "word " * 60, "WORD " * 60, "a b " * 30, " ".join(f"w{k}" for k in range(70)), " ".join(f"W{k}" for k in range(3000)), "é" * 500]
    texts += [" ".join(rnd.choices(words, k=rnd.randrange(1, 120))) for _ in range(40)]
    rows = [(rnd.choice([None, *range(60)]), rnd.choice(texts), rnd.choice([None, "", "en", "fr"]), rnd.choice([None, "", "a", "a", "a", "é", "b"])) for _ in range(n)]
    return rows + rows[:10]


# --- filters


def audit_by_hand(rows, labels):
    smallest = {}
    for i, t, _, _ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    docs = []
    for i, t, _, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        first = smallest.get(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": first is not None and (i is None or first < i)}
        docs.append((s or "", {k for k, v in fails.items() if v}, any(d == i and q == 1 for d, q, _ in labels), any(d == i and x == 1 for d, _, x in labels)))
    out = set()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        made, shapley = [], Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                made.append((part, "".join(order), step, len(left), len(gone), sum(f in d[1] for d in own) - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)))
        out |= {(*m, shapley[m[1][m[2] - 1]]) for m in made}
    return out


@pytest.mark.parametrize("held", [1, 32 << 20])
def test_filters_in_every_order(spark, monkeypatch, held):
    monkeypatch.setattr(filter_audit, "HELD_BYTES", held)
    rows = hard_documents()
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 60, 2)] + [(4, 1, 1), (None, 1, 1), (7, None, None)]
    said = spark.createDataFrame([(d, q, x, "clash") for d, q, x in labels], "doc_id long, quality int, toxic int, part string")
    got = [tuple(r) for r in filter_audit.audit(table(spark, rows).repartition(5), said).collect()]
    assert len(got) == len(set(got)) and set(got) == audit_by_hand(rows, [x for x in labels if x[0] is not None])


def test_filters_of_colliding_fingerprints(monkeypatch):
    monkeypatch.setattr(filter_audit.xxhash, "xxh64_intdigest", lambda data: 7)
    folded = list(filter_audit._folded([(3, "a", "x"), (2, "a", "y"), (1, "b", "x"), (None, "b", "y")]))
    found = sorted((str(i), part, bool(mask & filter_audit.COPY), n) for i, part, mask, n in filter_audit._resolved(folded))
    assert found == [("1", "b", False, 1), ("2", "a", False, 1), ("3", "a", True, 1), ("None", "b", True, 1)]


def test_one_text_in_most_rows_is_folded_before_the_shuffle():
    """A task sends a text once, whatever the number of its copies; the rest goes without text."""
    folded = list(filter_audit._folded([(i, "s", "same text") for i in range(1000)]))
    assert sum(record[0] is not None for _, record in folded) == 1
    assert len({route for route, record in folded if record[0] is None}) == 999


def test_filters_of_no_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(table(spark, []), labels).count() == 0
    one = [tuple(r) for r in filter_audit.audit(table(spark, [(1, None, None, None)]), labels).collect()]
    assert len(one) == 600 and {r[0] for r in one} == {""} and {r[4] for r in one if r[1][r[2] - 1] == "A"} == {1}


# --- terms


def divergence_by_hand(rows, least=3, top=200):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))) for _, t, lang, s in rows]
    df, count = defaultdict(Counter), defaultdict(Counter)
    for lang, s, w in docs:
        df[lang].update(set(w))
        count[lang, s].update(w)
    out = set()
    for lang in {d[0] for d in docs}:
        kept = [t for t, n in df[lang].items() if n >= least]
        groups = sorted(s for x, s in count if x == lang)

        def ps(c):
            whole = sum(c[t] for t in kept)  # noqa: B023
            return {t: 1 + 10**9 * (c[t] + 1) // (whole + len(kept)) for t in kept}  # noqa: B023

        p = {s: ps(count[lang, s]) for s in groups}
        q = ps(sum((count[lang, s] for s in groups), Counter()))
        for s in groups:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups if o != s]
            term = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, k) for k, (v, item) in enumerate(found, 1) if part == "pair" or k <= top}
    return out


@pytest.mark.parametrize("block, pairs, dense, sent", [(24 << 20, 1 << 16, 1024, 1 << 20), (300, 7, 1024, 1 << 20), (300, 7, 2, 0)])
def test_divergence(spark, monkeypatch, block, pairs, dense, sent):
    monkeypatch.setattr(divergence, "BLOCK_BYTES", block)
    monkeypatch.setattr(divergence, "PAIRS_AT_ONCE", pairs)
    monkeypatch.setattr(divergence, "DENSE", dense)
    monkeypatch.setattr(divergence, "GROUPS_SENT", sent)
    rows = hard_documents(5, 140) + [(500 + k, f"only{k}", "de", f"s{k % 3}") for k in range(5)]
    got = [tuple(r) for r in divergence.audit(table(spark, rows).repartition(3)).collect()]
    assert len(got) == len(set(got)) and set(got) == divergence_by_hand(rows)


def test_divergence_of_ranks_and_of_no_documents(spark):
    rows = [(k, " ".join(f"{'abcdefghij'[k % 10]}{x}" for x in ("rare", "word", "long")), "en", f"s{k % 4}") for k in range(60)]
    got = {tuple(r) for r in divergence.audit(table(spark, rows), top=2).collect()}
    assert got == divergence_by_hand(rows, top=2)
    assert divergence.audit(table(spark, [])).count() == 0


def test_terms_are_those_of_the_pattern():
    text = "".join(map(chr, range(1, 0x250))) + "日本 Éa b \U0001f600x"
    want = [t.encode() for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))]
    assert divergence.term_bytes(text.encode()).split() == want


# --- conversations

CHAT = "conv_id long, turn long, role string, text string, ids string, loss int"
TRICKY = ["</s>", "<\\/s>", "<\\\\/s>x", "[INST]", "[/INST] [\\INST]", "<|endoftext|>", "<", "</s", "[/INS", "\\", "<s><s>", "", "héé 日本 \U0001f600", "a\nb  c\t", "<\\", "[\\"]


def by_hand(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn is None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[c] = (len(turns), [(r, t) for _, _, r, t in turns], loss)
    return out


def test_conversations_come_back(spark):
    rnd = random.Random(2)
    rows = [(c, k, rnd.choice(["user", "assistant", "system", "a[INST]", None, ""]), rnd.choice(TRICKY) + rnd.choice(TRICKY)) for c in range(80) for k in range(rnd.randrange(1, 9))]
    rows += [(None, 1, "user", None), (None, None, "assistant", "last"), (200, 3, "assistant", "twice"), (200, 3, "assistant", "twice"), (200, 1, "assistant", None)]
    rows += [(300, k, "user" if k % 2 else "assistant", "long " * 5000) for k in range(6)]
    made = chat_format.formatted(spark.createDataFrame([(*r, "x", 1) for r in rows], CHAT).repartition(7))
    got = {r.conv_id: (len(r.turns), [tuple(t) for t in r.turns], "".join(r.learnt)) for r in chat_format.read_back(made).collect()}
    assert got == by_hand(rows)
    t = chat_format.PLAIN
    for r in made.collect():
        assert r.formatted.count(t.close) == r.formatted.count(t.open) == r.formatted.count(t.text_mark) == got[r.conv_id][0] and r.formatted.count(t.begin) == 1
        assert t.reserved[0] not in r.formatted and len(r.ids) == len(r.loss)


def test_ids_are_those_of_the_whole_text(spark):
    """One encoding of the rendered text, which its ids give back in full; the mask covers the assistant's tokens only."""
    c = chat_format.coder(open(chat_format.TOKENIZER, "rb").read(), chat_format.PLAIN)
    text, ids, loss = c.formatted([("user", "hi </s>"), ("assistant", "yé [INST] s"), ("assistant", ""), ("assistant", "z")])
    assert text == "<s>[INST]user[/INST]hi <\\/s></s>[INST]assistant[/INST]yé [\\INST] s</s>[INST]assistant[/INST]</s>[INST]assistant[/INST]z</s>"
    assert c.library.decode(ids, skip_special_tokens=False) == text
    assert c.library.decode([i for i, on in zip(ids, loss, strict=True) if on]) == "yé [\\INST] sz"
    assert c.learnt(ids, loss.tolist()) == ["yé [INST] s", "z"]


def test_escapes_are_reversible():
    t = chat_format.PLAIN
    for text in [a + b + c for a in TRICKY for b in TRICKY for c in TRICKY]:
        assert t.unescaped(t.escaped(text)) == text
        assert not any(m in t.escaped(text) for m in (*t.marks, *t.reserved))
    with pytest.raises(ValueError):
        chat_format.Template(close="</<s>")


def test_no_conversations(spark):
    assert chat_format.read_back(chat_format.formatted(spark.createDataFrame([], CHAT))).count() == 0


def test_the_added_conversation(spark, sf_dir):
    row = chat_format.op13_chat_format(spark, sf_dir).where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert row.n_turns == 2 and row.loss_chars == len(text) and row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_source_divergence", "op13_chat_format"])
def test_same_as_sql(spark, sf_dir, duck, same_rows, name):
    from groupforge.llm import queries

    got = queries.queries()[name](spark, sf_dir).toPandas()
    assert same_rows(got) == same_rows(duck.execute(queries.oracle_sql()[name]).df())
