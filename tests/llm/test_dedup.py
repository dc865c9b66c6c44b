"""Exact, line and near deduplication against brute force, on texts made to be awkward."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from groupforge.llm import blocks, common, exact_dedup, line_dedup, near_dup
from groupforge.llm.blocks import connect

SCHEMA = "doc_id long, text string, name string, size long, kept boolean"


def frame(spark, rows, tmp_path, name="docs"):
    path = str(tmp_path / name)
    spark.createDataFrame([(i, t, "x", 1, False) for i, t in rows], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


AWKWARD = [
    (1, "a  b\tc"), (2, "a b c"), (3, None), (4, ""), (5, " "), (6, "\n\n"), (7, "a b c "), (8, "x" * 10_000), (9, "x" * 10_000), (10, "x" * 9_999 + "y"),
    (11, "é" * 3000), (12, "é" * 3000), (12, "é" * 3000), (None, "a b c"), (13, "a b c"), (14, "x" * 4096), (15, "x" * 8192), (16, "x" * 4095),
]


@pytest.mark.parametrize(("block", "bits"), [(4096, 64), (16, 64), (64, 2), (4096, 1)])
def test_exact_groups(spark, tmp_path, block, bits):
    found = exact_dedup.exact_groups(frame(spark, AWKWARD, tmp_path), block_bytes=block, hash_bits=bits).collect()
    groups = defaultdict(list)
    for i, t in AWKWARD:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = []
    for t, ids in groups.items():
        keep = min(i for i in ids if i is not None)
        left = 1
        for i in sorted(ids, key=lambda x: (x is None, x)):
            want.append((i, keep, len(ids), i == keep and left == 1, hashlib.sha256(t.encode()).hexdigest()))
            left -= i == keep
    order = lambda x: tuple(str(v) for v in x)
    assert sorted(((r.id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found), key=order) == sorted(want, key=order)


def test_exact_dedup_keeps_columns_and_one_row(spark, tmp_path):
    docs = frame(spark, AWKWARD, tmp_path)
    out = exact_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 5, 7, 8, 10, 11, 13, 14, 15, 16]


@pytest.fixture
def other_splits(spark, monkeypatch):
    """Scans are split in another way after each written table, as when cores come and go."""
    setting, write, turns = "spark.sql.files.minPartitionNum", common.Scratch.write, ["1", "64", "7"]

    def written(self, *given, **more):
        path = write(self, *given, **more)
        turns.append(turns.pop(0))
        spark.conf.set(setting, turns[0])
        return path

    monkeypatch.setattr(common.Scratch, "write", written)
    spark.conf.set(setting, "64")
    yield
    spark.conf.unset(setting)


WORDY = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(40)] + [(100 + i, " ".join(f"w{i}x{k}" for k in range(30)) + " more") for i in range(0, 40, 3)]


def test_near_groups_when_splits_change(spark, tmp_path, other_splits):
    got = near_dup.near_groups(frame(spark, WORDY, tmp_path)).collect()
    assert sorted(r.id for r in got if not r.kept) == [i for i, _ in WORDY if i >= 100]


def test_kept_rows_when_splits_change(spark, tmp_path, other_splits):
    from groupforge.llm import source_mix, toxicity

    docs = frame(spark, WORDY, tmp_path)
    assert sorted(r.doc_id for r in near_dup.deduplicated(docs).collect()) == list(range(40))
    twice = frame(spark, [(i, t.replace(" more", "")) for i, t in WORDY], tmp_path, "twice")
    assert sorted(r.doc_id for r in exact_dedup.deduplicated(twice).collect()) == list(range(40))
    left = toxicity.not_toxic(docs, toxicity.Classifier({"more": 9.0}, -4.0)).collect()
    assert sorted(r.doc_id for r in left) == list(range(40))
    empty = frame(spark, [(i, t if i >= 100 else "") for i, t in WORDY], tmp_path, "empty")
    mixed = source_mix.mixed(empty, source_col="name", share=1.0).collect()
    assert sorted(r.doc_id for r in mixed) == [i for i, _ in WORDY]
    half = source_mix.mixed(empty, source_col="name", share=0.5).collect()
    assert sum(len(r.text.split()) for r in half) == 7 * 31 and sum(r.text == "" for r in half) == 40


def test_lines_when_splits_change(spark, tmp_path, other_splits):
    common_line = "a line that many of the documents hold"
    rows = [(i, f"own {i}\n{common_line}" if i % 4 == 0 else f"own {i}\nsecond {i}") for i in range(60)]
    got = {r.id: r.text for r in line_dedup.dropped(frame(spark, rows, tmp_path)).collect()}
    assert got == {i: f"own {i}" if i % 4 == 0 and i != 56 else t for i, t in rows}


def test_empty_tables(spark, tmp_path):
    docs = frame(spark, [], tmp_path)
    assert exact_dedup.exact_groups(docs).count() == 0
    assert line_dedup.dropped(docs).count() == 0
    assert near_dup.near_groups(docs).count() == 0


def lines_by_hand(rows):
    keyed = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(list)
    for place, (i, t) in enumerate(rows):
        for k in {keyed(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                holders[k].append((i, place))
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        stay = [x for x in own if len(keyed(x)) < 20 or len(holders[keyed(x)]) < 3 or i == max(j for j, _ in holders[keyed(x)])]
        out.append((i, len(own), len(own) - len(stay), "\n".join(stay)))
    return out


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_lines(spark, tmp_path, batches):
    rnd = random.Random(batches)
    pool = [f"This line number {k} is long enough" for k in range(12)] + ["short", "", "  Padded LINE that is long enough\t", "padded line that is long enough", "É" * 20, "é" * 20, "x" * 19, "\x85" + "y" * 19]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 9)))) for i in range(60)] + [(60, None), (61, "\n\n"), (62, "tail line that is long enough\n" * 3), (63, "z" * 200_000)]
    got = line_dedup.dropped(frame(spark, rows, tmp_path), batches=batches).collect()
    assert sorted((r.id, r.n_lines, r.n_dropped, r.text) for r in got) == sorted(lines_by_hand(rows))


def test_lines_of_null_and_repeated_ids(spark, tmp_path):
    line = "a line that is long enough to count"
    got = line_dedup.dropped(frame(spark, [(None, line), (None, f"{line}\nx"), (1, line), (9, line), (9, f"{line} \n{line}")], tmp_path)).collect()
    assert sorted((str(r.id), r.n_lines, r.n_dropped, r.text) for r in got) == [("1", 1, 1, ""), ("9", 1, 0, line), ("9", 2, 0, f"{line} \n{line}"), ("None", 1, 1, ""), ("None", 2, 1, "x")]


def test_runs_hold_each_key_once_and_compact(spark):
    scratch = common.Scratch(spark, "runs")
    runs = line_dedup.Runs(scratch)
    with line_dedup.ordered_buckets(spark):
        for b in range(5):
            batch = runs.read(runs.write(spark.range(b * 7, b * 7 + 10).selectExpr("id as h1", "id as h2", "1L as n", "id as last"), "batch"))
            fresh = runs.fresh(batch)
            plan = fresh._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Sort " not in plan and plan.count("SortMergeJoin") == len(runs.all()), plan
            runs.add(fresh, dealt=True)
            runs.compact()
            for level in runs.levels:
                for table in level:
                    assert "Sort " not in runs.read(table).sortWithinPartitions("h1", "h2")._jdf.queryExecution().executedPlan().toString()
        held = [[r.h1 for r in run.collect()] for run in runs.all()]
    assert sorted(sum(held, [])) == list(range(38)) and len(held) <= 3
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("groupforge_")]


def components_by_hand(n, links):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


def near_by_hand(rows, words, percent):
    sets = []
    for _, t in rows:
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    part = components_by_hand(len(rows), links)
    return [(rows[a][0], len(sets[a]), rows[part[a]][0], part[a] == a) for a in range(len(rows))]


@pytest.mark.parametrize(("group_block", "cluster_block"), [(2000, 400), (7, 5), (2, 2)])
def test_near_groups(spark, tmp_path, group_block, cluster_block):
    rnd = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [None, "", "  ", "One two", "one TWO", "one two three", "a b c d", "a b c d e"]
    for _ in range(6):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(40, 150))]
        texts.append(" ".join(base))
        for _ in range(14):
            near = list(base)
            for _ in range(rnd.randint(0, 8)):
                near[rnd.randrange(len(near))] = rnd.choice(vocabulary)
            texts.append("\n".join(near))
        texts.append(" ".join(base))
    long = [rnd.choice(vocabulary) for _ in range(30_000)]
    texts += [" ".join(long), " ".join(long + ["end"])]
    rows = list(enumerate(texts))
    got = near_dup.near_groups(frame(spark, rows, tmp_path), words=4, group_block=group_block, cluster_block=cluster_block).collect()
    assert sorted((r.id, r.n_shingles, r.component_id, r.kept) for r in got) == near_by_hand(rows, 4, 80)


def test_near_rows_that_repeat_ids(spark, tmp_path):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, None), (7, "q")]
    got = near_dup.near_groups(frame(spark, rows, tmp_path), words=4).collect()
    assert sorted((str(r.id), str(r.component_id), r.kept) for r in got) == [("5", "5", True), ("5", "5", True), ("7", "7", True), ("None", "5", False), ("None", "None", True)]
    assert sum(r["head"] for r in got) == 3
    assert sorted(str(r.doc_id) for r in near_dup.deduplicated(frame(spark, rows, tmp_path, "again")).collect()) == ["5", "7", "None"]


def test_a_large_cluster_of_one_component_meets_once(spark):
    """Members of one component cost nothing in step 2; those of others meet all members that they are apart from, once."""
    scratch = common.Scratch(spark, "apart")
    rows = scratch.stage(spark.range(40).selectExpr("1L as key", "id as row", "4 as size"), "rows")
    parts = lambda f: spark.createDataFrame([(i, f(i)) for i in range(40)], "node long, component long")
    assert blocks.apart(rows, "key", "row", "size", scratch, parts(lambda i: 0)) is None
    part = lambda i: i if i >= 34 else 0
    units = {}
    for r in blocks.apart(rows, "key", "row", "size", scratch, parts(part)).collect():
        units.setdefault((r.low, r.high), []).append((r.row, r.block))
    met = [(min(a, b), max(a, b)) for (low, high), members in units.items() for a, x in members for b, y in members if a < b and (low == high or x != y)]
    assert len(met) == len(set(met)) and {m for m in met if part(m[0]) != part(m[1])} == {(a, b) for b in range(34, 40) for a in range(b)}


def test_bayes_bounds_keep_likely_pairs():
    for seen, need in near_dup.least_equal(240):
        rnd = np.random.default_rng(1)
        equal = (rnd.random((20_000, seen)) < 0.8 + 0.2 / 256).sum(axis=1)
        assert (equal >= need).mean() > 0.9999
        assert need > 0.2 * seen
    assert near_dup.miss_probability(0.8) < 1e-4


def test_connect_emits_each_link_once():
    rnd = np.random.default_rng(2)
    n = 300
    units = np.sort(rnd.integers(0, 12, n))
    signature = rnd.integers(0, 3, (n, 16), dtype=np.uint8)
    least = [(16, 9)]
    label = connect(units, np.zeros(n, bool), np.zeros(n, int), np.full(n, 10), signature, least, 80)
    links = [(a, b) for a in range(n) for b in range(a) if units[a] == units[b] and (signature[a] == signature[b]).sum() >= 9]
    assert label.tolist() == components_by_hand(n, links)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rnd = random.Random(seed)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(200, 260)]
    want = components_by_hand(261, links)
    got = common.components(common.Scratch(spark, "parts"), spark.createDataFrame(links, "a long, b long")).collect()
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert sorted((r.node, r.component) for r in got) == [(x, want[x]) for x in sorted(touched)]


def stages_of(spark, name, links):
    """What components() gives for links, and how many stages ran for it."""
    context = spark.sparkContext
    context.setJobGroup(name, name)
    try:
        got = common.components(common.Scratch(spark, "parts"), spark.createDataFrame(links, "a long, b long")).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    jobs = [context.statusTracker().getJobInfo(j) for j in context.statusTracker().getJobIdsForGroup(name)]
    infos = [context.statusTracker().getStageInfo(s) for j in jobs for s in j.stageIds]
    return {r.node: r.component for r in got}, sum(1 for i in infos if i and i.numCompletedTasks)


def test_components_take_few_shuffles(spark):
    stars = [(k * 1000, k * 1000 + i) for k in range(4) for i in range(1, 60)]
    got, plain = stages_of(spark, "stars", stars)
    assert got == {x: x // 1000 * 1000 for link in stars for x in link}
    assert plain <= 8  # nothing is left to join: no round, and none that finds it so
    path = [(i, i + 1) for i in range(500)]
    random.Random(4).shuffle(path)
    got, long = stages_of(spark, "path", path)
    assert got == dict.fromkeys(range(501), 0)
    assert long <= 60


def test_contracted_slices_keep_whole_nodes(spark, monkeypatch):
    monkeypatch.setattr(common, "CONTRACTED", 7)
    links = [(i, i + 1) for i in range(120)] + [(500, i) for i in range(200, 300)]
    got = common.components(common.Scratch(spark, "parts"), spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == dict.fromkeys(range(121), 0) | dict.fromkeys([500, *range(200, 300)], 200)
