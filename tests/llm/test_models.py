"""Toxicity, vectors and source mixing."""

import itertools
import random

import numpy as np
import pytest

from groupforge.llm import common, source_mix, toxicity, vector_links

# --- toxicity


def model_of(rows, fairness):
    names = sorted({x for _, t in rows for x in toxicity.features(t) if not x.startswith("noise")})
    place = {x: i for i, x in enumerate(names)}
    return toxicity.fit([(label, [place[x] for x in toxicity.features(t) if x in place]) for label, t in rows], names, toxicity.IDENTITY, fairness=fairness)


def test_swaps_lower_the_weight_of_group_names():
    rnd = random.Random(1)
    rows = []
    for i in range(1500):
        toxic = i % 2
        words = rnd.sample([f"noise{k}" for k in range(50)], 6) + ["idiot"] * (toxic and rnd.random() < 0.95) + ["muslims"] * (rnd.random() < (0.5 if toxic else 0.05))
        rows.append((toxic, " ".join(words)))
    plain, fair = model_of(rows, 0.0), model_of(rows, 1.0)
    assert plain.score("the muslims came") > 0.3
    assert fair.score("the muslims came") < 0.15
    assert abs(fair.score("the muslims came") - fair.score("the women came")) < 0.01
    assert fair.score("an idiot came") > 0.9


def test_penalty_is_that_of_swapped_sentences():
    """The closed form against sentences that are swapped one by one."""
    rnd = random.Random(3)
    groups = ["women", "men", "jews", "refugees"]
    texts = [[rnd.choice(["xa", "yb", "zc"]), *rnd.sample(groups, rnd.choice([0, 1, 1, 1]))] for _ in range(40)]
    names = sorted({x for w in [*groups, "xa", "yb", "zc"] for x in toxicity.parts(w)})
    place = {x: i for i, x in enumerate(names)}

    def logit(words, w):
        return sum(w[place[x]] for x in toxicity.features(" ".join(words)) if x in place)

    def penalty(w):
        changes = [logit([h if x == g else x for x in t], w) - logit(t, w) for t in texts for g in groups if g in t for h in groups if h != g]
        return np.mean(np.square(changes))

    of_term = np.zeros((len(groups), len(names)))
    for i, g in enumerate(groups):
        of_term[i, [place[x] for x in toxicity.parts(g)]] = 1.0
    named = np.array([sum(g in t for t in texts) for g in groups], dtype=float)
    w = np.random.default_rng(3).normal(size=len(names))
    step = 1e-6 * np.eye(len(names))
    by_hand = [(penalty(w + d) - penalty(w - d)) / 2e-6 for d in step]
    assert np.allclose(toxicity.swap_gradient(of_term, named, w), by_hand, atol=1e-6)


def test_neutral_mentions_of_groups(spark):
    """Groups are named in toxic texts more often; texts that name another group, without abuse, are left alone."""
    rnd = random.Random(5)
    filler = [f"f{k}" for k in range(40)]
    docs = []
    for i in range(1600):
        toxic = i % 4 == 0
        names = ["refugees"] * (rnd.random() < (0.7 if toxic else 0.03)) + ["women"] * (rnd.random() < 0.1)
        docs.append((i, " ".join(rnd.sample(filler, 8) + names + ["vermin"] * (toxic and rnd.random() < 0.9)), int(toxic)))
    table = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in docs], "doc_id long, toxic int")
    plain, fair = (toxicity.train(table, labels, features=3, fairness=f) for f in (0.0, 1.0))
    neutral = [f"the {g} came {f}" for g in ("refugees", "women", "muslims") for f in filler[:10]]
    assert "refugees" in fair.weights and "vermin" in fair.weights
    assert max(fair.score(t) for t in neutral) < 0.3 and max(plain.score(t) for t in neutral) > max(fair.score(t) for t in neutral) + 0.1
    assert fair.score("vermin f1") > 0.5


def test_labels_of_one_kind_and_empty_texts():
    assert toxicity.fit([(0, []), (0, [])], [], []).score("x") < 0.01
    assert toxicity.fit([(1, [])], [], []).score(None) > 0.99
    assert toxicity.fit([], [], []).score("") < 0.01


def test_toxicity_rows(spark, tmp_path):
    rnd = random.Random(2)
    docs = [(i, " ".join([rnd.choice("alpha beta gamma delta".split()) for _ in range(20)] + ["vile"] * (i % 4 == 0)), i % 4 == 0) for i in range(400)]
    texts = [(i, t, 1.0) for i, t, _ in docs] + [(500, None, 1.0), (501, "", 1.0), (None, "vile", 1.0), (7, "repeated id", 1.0)]
    spark.createDataFrame(texts, "doc_id long, text string, score double").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(x)) for i, _, x in docs] + [(500, 0), (501, None), (None, 1), (0, 1)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = toxicity.op4_toxicity(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    by = {r.doc_id: r for r in rows if r.doc_id != 7}
    assert all(by[i].predicted == int(x) for i, _, x in docs if i != 7)
    assert by[500].score == by[501].score < 0.5 and by[None].predicted == 1
    assert {r.held_out for r in rows} == {True, False}
    kept = toxicity.not_toxic(spark.read.parquet(str(tmp_path / "documents.parquet")), toxicity.Classifier({"vile": 9.0}, -4.0))
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == len(texts) - 101


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    rows = toxicity.op4_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out and toxic is not null").collect()
    toxic = [r.predicted for r in rows if r.toxic]
    assert len(toxic) > 50 and sum(toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.01 * sum(not r.toxic for r in rows)


def test_empty_documents(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scored(docs, toxicity.train(docs, labels)).count() == 0


# --- vectors


def links_by_hand(rows, cosine=0.93):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and label is not None for _, v, label in rows]
    unit = [np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64)) if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    n, part = [0] * len(rows), list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
            n[a] += 1
            n[b] += 1
            x, y = part[a], part[b]
            part = [min(x, y) if p in (x, y) else p for p in part]
    return [(rows[i][0], n[i], rows[part[i]][0], rows[i][0] == rows[part[i]][0]) for i in range(len(rows))]


def awkward_vectors(seed):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, 16))
    rows = []
    for i in range(260):
        v = centres[rnd.integers(12)] + rnd.normal(size=16) * rnd.choice([0.0, 0.05, 0.2, 1.0])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(rnd.integers(3))))
    one = rows[0][1]
    return rows + [(300, None, 1), (301, [], 1), (302, [0.0] * 16, 1), (303, [float("nan")] + one[1:], 0), (304, [None] + one[1:], 0), (305, one, None), (306, one, rows[0][2]), (307, one, rows[0][2]), (308, [2 * x for x in one], rows[0][2]), (309, one[:8], rows[0][2]), (310, [float("inf")] + one[1:], 0)]


@pytest.mark.parametrize("block", [600, 7])
def test_links(spark, tmp_path, block):
    rows = awkward_vectors(block)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(str(tmp_path / "v"))
    got = vector_links.linked(spark.read.parquet(str(tmp_path / "v")), block=block).collect()
    want = links_by_hand(rows)
    found, there = sum(r.n_links for r in got), sum(x[1] for x in want)
    assert 0.9 * there <= found <= there
    exact = sorted((r.id, r.n_links, r.component_id, r.kept) for r in got)
    assert sum(a == b for a, b in zip(exact, want, strict=True)) >= 0.9 * len(want)


def test_null_and_repeated_ids_and_other_columns(spark):
    v, w = [1.0, 0.0], [0.99, 0.05]
    rows = [(5, v, 1, 0.5, "x"), (5, v, 1, 0.5, "x"), (6, w, 1, 0.5, "x"), (None, v, 1, 0.5, "x"), (7, [3.0] * 3000, 1, 0.5, "x")]
    got = vector_links.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, vec double, part string")).collect()
    assert sorted((str(r.id), r.n_links, str(r.component_id), r.kept) for r in got) == [("5", 2, "5", True), ("5", 2, "5", True), ("6", 2, "5", False), ("7", 0, "7", True), ("None", 0, "None", True)]


def test_many_copies_of_a_vector(spark):
    rows = [(i, [1.0, 2.0], 1) for i in range(9000)] + [(9000 + i, [1.0, 2.0 + 1e-3 * i], 1) for i in range(1, 40)]
    got = vector_links.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)).collect()
    assert len(got) == 9039 and {(r.n_links, r.component_id, r.kept) for r in got if r.id} == {(9038, 0, False)}


def planted(n, dims, seed):
    """n pairs at cosines of 0.93 to 0.95, and as many vectors without a link."""
    rnd = np.random.default_rng(seed)
    a, side = rnd.normal(size=(n, dims)), rnd.normal(size=(n, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rnd.uniform(0.9301, 0.95, (n, 1))
    return a, cosine * a + np.sqrt(1 - cosine**2) * side


@pytest.mark.parametrize("pivots", [134, 2048, vector_links.PIVOTS_MOST])
def test_recall_by_number_of_pivots(pivots):
    a, b = planted(400, 64, 1)
    chosen = np.random.default_rng(2).normal(size=(pivots, 64))
    chosen /= np.linalg.norm(chosen, axis=1, keepdims=True)
    near = [vector_links.prefixes(x, chosen) for x in (a, b)]
    shared = np.array([len(np.intersect1d(x, y)) for x, y in zip(*near, strict=True)])
    assert (shared >= vector_links.SHARED).mean() >= 0.9


def test_recall_on_planted_links(spark):
    a, b = planted(1500, 64, 3)
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(np.concatenate([a, b]))]
    there = int((np.concatenate([a, b]) @ np.concatenate([a, b]).T >= 0.93).sum()) - len(rows)
    found = vector_links.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).agg({"n_links": "sum"}).first()[0]
    assert there >= 3000 and 0.9 * there <= found <= there


def test_prefixes_are_the_nearest():
    rnd = np.random.default_rng(4)
    unit, chosen = rnd.normal(size=(300, 8)), rnd.normal(size=(50, 8))
    chosen[10] = chosen[20]
    assert (vector_links.prefixes(unit, chosen) == np.argsort(-(unit @ chosen.T), axis=1, kind="stable")[:, : vector_links.PREFIX]).all()


def test_all_links_when_pivots_needn_not_agree(spark, tmp_path):
    rows = awkward_vectors(5)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "v"))
    got = vector_links.linked(spark.read.parquet(str(tmp_path / "v")), prefix=32, shared=1).collect()
    assert sorted((r.id, r.n_links, r.component_id, r.kept) for r in got) == links_by_hand(rows)


def test_no_vectors(spark):
    assert vector_links.linked(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# --- mixing


def targets(sizes, weights, share=1.5, most=2.0):
    """Budget of each source, in the order given."""
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        total = sum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        for i in above or open_:
            out[i] = most * sizes[i] if above else left * weights[i] / total
        if not above:
            break
        left -= sum(out[i] for i in above)
        open_ = [i for i in open_ if i not in above]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_goals_of_sources(spark, seed):
    rnd = random.Random(seed)
    names = [*{"".join(rnd.choice("abéz🙂ÿ~") for _ in range(rnd.randint(0, 4))) for _ in range(30)}, None]
    sizes = {n: rnd.choice([0, 1, 50, 10_000, 400]) for n in names}
    table = spark.createDataFrame([("" if n is None else "s" + n, 3, s) for n, s in sizes.items()], "key string, docs long, words long").repartition(5)
    got = {r.key: r for r in source_mix.goals_of(table, common.Scratch(spark, "goals")).collect()}
    order = [*sorted(n for n in names if n is not None), None]
    for n, aim in zip(order, targets([sizes[n] for n in order], [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True):
        r = got["" if n is None else "s" + n]
        assert (r.docs, r.source_size, r.target) == (3, sizes[n], aim)
        assert r.whole * sizes[n] + r.rest == round(aim) or r.whole >= 2


@pytest.mark.parametrize("seed", range(6))
def test_fit_comes_to_the_budget(seed):
    rnd = random.Random(seed)
    lengths = sorted(rnd.sample(range(1, 60), 6))
    counts = [rnd.randint(1, 4) for _ in lengths]
    sums = sorted({words_of(lengths, k) for k in itertools.product(*[range(c + 1) for c in counts])})
    for budget in range(0, sums[-1] + 2):
        take = source_mix.fit(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
        assert words_of(lengths, take) == max(s for s in sums if s <= budget)


def test_fit_of_large_budgets_is_close():
    rnd = random.Random(9)
    lengths = sorted(rnd.sample(range(20, 20_000), 3000))
    counts = [rnd.randint(1, 50) for _ in lengths]
    total = sum(a * b for a, b in zip(lengths, counts, strict=True))
    for share in (0.1, 0.5, 0.93):
        budget = int(total * share)
        assert sum(a * b for a, b in zip(lengths, source_mix.fit(lengths, counts, budget), strict=True)) == budget


def words_of(lengths, take):
    return sum(a * b for a, b in zip(lengths, take, strict=True))


def test_fit_with_a_document_that_holds_most_of_a_source():
    for lengths, counts, budget in (([250, 200_000], [400, 1], 240_000), ([250, 60_000], [120, 1], 72_000), ([250, 130_000, 200_000], [10, 2, 1], 260_000)):
        take = source_mix.fit(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True)) and words_of(lengths, take) == budget


@pytest.mark.parametrize("swap", [source_mix.SWAP_WORDS, 2 * 90 * 90])
@pytest.mark.parametrize("seed", range(8))
def test_fit_comes_to_the_best_reachable_sum(seed, swap):
    rnd = random.Random(seed)
    lengths = sorted(rnd.sample(range(7, 60), 3)) + [90]
    counts = [rnd.randint(1, 12) for _ in lengths[:-1]] + [rnd.choice([1, 2, 400])]
    sums = np.array(sorted({words_of(lengths, k) for k in itertools.product(*[range(c + 1) for c in counts])}))
    for budget in range(0, int(sums[-1]) + 2, 7 if sums[-1] < 20_000 else 501):
        take = source_mix.fit(lengths, counts, budget, table=64, swap=swap)
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
        assert words_of(lengths, take) == sums[np.searchsorted(sums, budget, "right") - 1]


def test_mixture(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 40)), rnd.choice(["a", "b", "hot", "hot", "hot", None]), 1) for i in range(600)] + [(700, None, "a", 1), (701, "", "empty", 1), (5, "x y", "hot", 1), (5, "x y", "hot", 1), (None, "x", "b", 1), (800, "long " * 300, "hot", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, size long").repartition(4).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = source_mix.mixture(docs, range_bits=3).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert r.taken in (0, r.size, 2 * r.size)
    words = {s: sum(r.size for r in rs) for s, rs in by.items()}
    order = sorted((s for s in words if s is not None)) + [None]
    aims = targets([words[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
    for s, aim in zip(order, aims, strict=True):
        assert abs(by[s][0].target - aim) < 1e-6 and by[s][0].source_size == words[s]
        assert abs(sum(r.taken for r in by[s]) - aim) <= 1
    assert abs(sum(aims) - 1.5 * sum(words.values())) < 1e-6
    again = source_mix.mixture(docs, range_bits=3).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = source_mix.mixed(docs, range_bits=3)
    assert out.columns == docs.columns
    assert out.where("text is not null and text <> ''").count() == sum(r.copies for r in got if r.size)


def test_no_documents_to_mix(spark):
    assert source_mix.mixture(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


@pytest.mark.parametrize("uneven", [1, 4096])
def test_very_large_and_very_small_vectors_link(spark, monkeypatch, uneven):
    """Magnitudes whose squares leave the doubles on either side, against the SQL too."""
    import duckdb
    import pyarrow as pa

    monkeypatch.setattr(common, "UNEVEN", uneven)
    rows = [
        (1, [1e200, 2e200], 1), (2, [1e200, 2e200], 1), (3, [1e-200, 2e-200], 1), (4, [1e-200, 2e-200], 1), (5, [1.0, 2.0], 1), (6, [5e-324, 0.0], 2), (7, [1e308, 1e290], 2), (8, [0.0, 0.0], 1),
        (9, [2e200, -1e200], 1), (10, [1.0, float("inf")], 1), (11, [1.0, 2.0], 3), (12, [-1e-310, 2e-310], 1), (13, [0.0, 1e300], 2),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.id: (r.n_links, r.component_id) for r in vector_links.linked(table).collect()}
    assert {k: got[k] for k in range(1, 6)} == {k: (4, 1) for k in range(1, 6)}
    assert got[6] == (1, 6) and got[7] == (1, 6) and got[11] == (0, 11)
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": [r[0] for r in rows], "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float64())), "label": [r[2] for r in rows]}))
    assert {r[0]: r[1:3] for r in con.execute(vector_links.OP7_SQL).fetchall()} == got
