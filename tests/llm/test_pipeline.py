"""The queries' SQL, and the pipeline against the same stages by hand."""

import hashlib
import random
import re
from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline
from groupforge.llm import piece_queries, queries
from tests.llm.test_dedup import near_by_hand
from tests.llm.test_models import targets

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, duck, same_rows, name):
    got = queries.queries()[name](spark, sf_dir).toPandas()
    assert same_rows(got) == same_rows(duck.execute(SQL[name]).df())


def test_one_query_for_each_operator():
    assert [sum(k.startswith(f"op{n}_") for k in queries.queries()) for n in range(1, 11)] == [1] * 10


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(8)
    vocabulary = [f"word{k}" for k in range(300)]
    texts = []
    for i in range(120):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(8, 120))]
        texts.append(" ".join(base + ["vile"] * (i % 5 == 0)))
        if i % 4 == 1:
            near = list(base)
            near[len(near) // 2] = "changed"
            texts += [" ".join(near), "  ".join(base)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t)) for i, t in enumerate(texts)] + [(900, None, None, "s1", None), (901, "", "en", "s1", 0)]
    sf = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(sf / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, int("vile" in (r[1] or ""))) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(sf / "labels.parquet"))
    return str(sf), rows


def test_pipeline(spark, corpus):
    sf, rows = corpus
    left = [r for r in rows if "vile" not in (r[1] or "")]
    seen, kept = set(), []
    for r in sorted(left):
        t = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        if t not in seen:
            seen.add(t)
            kept.append(r)
    near = near_by_hand([(r[0], r[1]) for r in kept], 5, 80)
    kept = [r for r, n in zip(kept, near, strict=True) if n[3]]
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} <= {r[0] for r in kept}
    by_id = {r[0]: r for r in kept}
    library = sentencepiece.SentencePieceProcessor(model_file=piece_queries.MODEL)
    for r in got:
        ids = library.encode(by_id[r.doc_id][1] or "", add_eos=True)
        assert r.n_tokens == len(ids) and r.source == by_id[r.doc_id][3]
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in kept}
    order = sorted({r[3] for r in kept} - {None}) + [None]
    words = Counter()
    for r in kept:
        words[r[3]] += size[r[0]]
    taken = Counter()
    for r in got:
        taken[r.source] += size[r.doc_id]
    for s, aim in zip(order, targets([words[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True):
        assert abs(taken[s] - aim) <= 1
    assert max(Counter(r.doc_id for r in got).values()) <= 2
    assert got and {r.doc_id for r in got} >= {r[0] for r in kept if size[r[0]] == 0}


def test_stages_keep_columns(spark, corpus):
    sf, _ = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_stages_of_an_empty_table(spark, corpus, tmp_path):
    sf, _ = corpus
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_with_nulls_repeats_and_other_columns(spark, corpus, stage):
    sf, _ = corpus
    rows = [(None, None, None, None, None, 1), (1, "a b c d e f g", "en", "s1", 9, 1), (1, "a b c d e f g", "en", "s1", 9, 1), (2, None, "en", None, None, 1), (3, "long " * 50_000, None, "s1", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long")
    out = stage(spark, docs, sf)
    assert out.count() >= 1 and "doc_id" in out.columns
