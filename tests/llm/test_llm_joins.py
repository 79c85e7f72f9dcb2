"""Words, projections, regions and the whole join against brute force."""

import gc
import os
import random
import re
import time
from collections import defaultdict

import llm_cases as cases
import numpy as np
import pyarrow as pa
import pytest

from trailfold.llm import components as C
from trailfold.llm import jaccard_join as J
from trailfold.llm import words as W
from trailfold.llm.common import text_bytes
from trailfold.llm.components import components


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(rows, k, num, den):
    """{id: (size, component)} by comparing every pair."""
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            a, b = sets[i], sets[j]
            if i < j and a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies(seed, groups=12, most=14):
    """Groups of texts with few edits, around the thresholds, and texts that share a passage."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    out = []
    for _ in range(groups):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 12, 40, 120]))]
        for _ in range(rng.randint(1, most)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                text[rng.randrange(len(text))] = f"w{rng.randrange(500)}"
            if rng.random() < 0.15:
                text = text + passage
            out.append(" ".join(text).upper() if rng.random() < 0.2 else " ".join(text))
    return list(enumerate(out))


def test_words_over_block_borders(monkeypatch):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(200_000)]
    data, offsets = text_bytes(pa.array([" ".join(words), None, "", "A b"]))
    starts, ends, text = W.spans(data, offsets)
    hashed = W.hashes(data, starts, ends)
    assert len(hashed) == len(words) + 2 and text.tolist()[-2:] == [3, 3]
    by_word = defaultdict(set)
    for w, h in zip(words, hashed.tolist()):
        by_word[w].add(h)
    assert all(len(v) == 1 for v in by_word.values()) and len(set().union(*by_word.values())) == len(by_word)


@pytest.mark.parametrize("k", [1, 3, 5])
def test_shingle_sets(k):
    rng = random.Random(k)
    texts = ["".join(rng.choice(["a", "B", "b", "é", " ", "  ", "\n", "the", "The"]) for _ in range(rng.choice([0, 1, 4, 50])))
             for _ in range(600)]
    sets = W.shingle_sets(*text_bytes(pa.array(texts)), k)
    names = {}
    for t, s in zip(texts, sets):
        assert len(s) == len(shingles(t, k)), t
        assert names.setdefault(shingles(t, k), s.tobytes()) == s.tobytes()
    assert len(set(names.values())) == len(names)


@pytest.mark.parametrize("num,den", [(9, 10), (8, 10), (1, 2), (1, 1)])
def test_linked_sets_share_a_projection(num, den):
    """Also at the very threshold, and with many empty projections."""
    rng = np.random.default_rng(num * 10 + den)
    threshold = J.Threshold(num, den)
    met = 0
    for n in [1, 2, 5, 9, 10, 11, 19, 20, 40, 95, 300, 1000] * 12:
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        d = threshold.most(2 * len(a))
        gone = rng.integers(0, d + 1) if d else 0
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[gone:]], rng.integers(0, 1 << 63, int(rng.integers(0, d - gone + 1)) if d else 0,
                                                                                      dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and threshold.links(both, len(a), len(b)) and not np.array_equal(a, b):
            met += 1
            assert len(np.intersect1d(J.projections(a, threshold), J.projections(b, threshold))), (n, len(b), both)
    assert met or num == den


@pytest.mark.parametrize("direct", [4, 48])
def test_regions_are_joined_exactly(monkeypatch, direct):
    monkeypatch.setattr(J, "DIRECT", max(direct, J.TASK_PIVOTS))
    rows = copies(3, 10, 20)
    sets = W.shingle_sets(*text_bytes(pa.array([t for _, t in rows])), 3)
    pairs = J.join_region(sets, J.Threshold(9, 10))
    root = list(range(len(sets)))
    for _ in range(len(sets)):
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    assert len(pairs) <= len(sets) - len(set(root))
    assert {i: r for i, r in enumerate(root)} == {i: c for i, (_, c) in brute(rows, 3, 9, 10).items()}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (200, 200), (-5, 100)] + [(300, i) for i in range(301, 400)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {100: -5, 101: -5, -5: -5} | {i: 300 for i in range(300, 400)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_edges_are_connected_without_rounds_of_jobs(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1200)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(4)
    written = []
    monkeypatch.setattr(C, "saved", lambda df: written.append(1) or J.saved(df))
    few = {(r["node"], r["component"]) for r in components(frame).collect()}
    assert len(written) <= 2
    monkeypatch.setattr(C, "FEW", 0)
    monkeypatch.setattr(C, "AT_ONCE", 20)
    assert {(r["node"], r["component"]) for r in components(frame).collect()} == few
    assert len(few) == len({x for a, b in edges if a != b for x in (a, b)})


def test_shuffle_files_of_the_points_go_before_the_sets_are_written(spark, monkeypatch):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        paths = files.getAllFiles().mkString("\n").split("\n")
        return sum(os.path.getsize(p) for p in paths if "/shuffle_" in p and os.path.exists(p))

    def freed():
        for _ in range(20):
            gc.collect()
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.2)
            if shuffled() <= base + 10_000:
                break
        return shuffled() - base

    seen, real = {}, J.saved

    def saved(df):
        if "found" in df.columns and "component" in df.columns and not seen:
            seen["sets"] = freed()
        return real(df)

    base = 1 << 60
    freed()
    base = shuffled()
    monkeypatch.setattr(J, "saved", saved)
    J.near_duplicates(spark.createDataFrame(copies(3, groups=40), "doc_id long, text string")).count()
    assert seen["sets"] <= 10_000


@pytest.mark.parametrize("k,num,region", [(3, 90, 256), (5, 80, 256), (3, 80, 12)])
def test_join_equals_brute_force(spark, monkeypatch, k, num, region):
    monkeypatch.setattr(J, "REGION", region)
    monkeypatch.setattr(J, "PIVOTS", min(J.PIVOTS, region // 3))
    rows = copies(k * num)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_duplicates(docs, k, num, 100).collect()}
    assert got == brute(rows, k, num, 100)


def large_cluster(seed, n=90):
    """One text with few edits, and texts that hold half of it and are linked with few others."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(60)]
    out = []
    for i in range(n):
        text = list(base)
        if i % 9 == 4:
            text[30:] = [f"t{i // 27}_{j}" for j in range(30)]
        for _ in range(rng.choice([0, 1, 1, 2])):
            text[rng.randrange(len(text))] = f"x{rng.randrange(2000)}"
        out.append(" ".join(text))
    return list(enumerate(out))


@pytest.mark.parametrize("blocks", [2, 24])
def test_large_clusters_in_blocks_and_points(spark, monkeypatch, blocks):
    monkeypatch.setattr(J, "REGION", 12)
    monkeypatch.setattr(J, "BLOCKS", blocks)
    monkeypatch.setattr(J, "PIVOTS", 4)
    rows = large_cluster(blocks)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 3, 80, 100)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_duplicates(docs, 3, 80, 100).collect()}
    assert got == want and 1 < len({c for _, c in want.values()}) < 60


@pytest.mark.parametrize("blocks", [2, 24])
def test_a_large_group_yields_few_edges(spark, monkeypatch, blocks):
    """Each of its many projections gave a spanning forest of its own."""
    monkeypatch.setattr(J, "REGION", 12)
    monkeypatch.setattr(J, "BLOCKS", blocks)
    monkeypatch.setattr(J, "PIVOTS", 4)
    rows = [(i, " ".join(f"b{j}" if j != i % 60 else f"x{i}" for j in range(60))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    edges, real = [], J.components

    def noted(links):
        edges.append(links.count())
        return real(links)

    monkeypatch.setattr(J, "components", noted)
    done = J.near_duplicates(docs, 3, 80, 100).collect()
    assert {r["component_id"] for r in done} == {0}
    assert edges[-1] < 4 * len(rows)


def test_rows_without_copies_are_not_shuffled(spark):
    """The rows to go were found by a join that shuffled the whole table."""
    rows = [(i, f"a{i} b{i} c{i} d{i} e{i}") for i in range(200)] + [(200 + i, f"a{i} b{i} c{i} d{i} e{i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = J.one_of_each(docs)
        got = sorted(r["doc_id"] for r in kept.collect())
        plan = kept._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == list(range(200))
    first = plan[plan.index("Union"):plan.index("SortMergeJoin")]
    assert "BroadcastHashJoin" in first


def test_awkward_documents(spark):
    docs = cases.awkward(spark)
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in J.near_duplicates(docs).collect())
    long_size = len(shingles(cases.LONG, 3))
    assert got == [("1", 5, 1), ("1", 5, 1), ("2", 0, 2), ("3", 0, 3), ("4", 0, 4), ("5", long_size, 5),
                   ("6", 6, 6), ("7", 1, 7), ("8", 1, 8), ("None", 5, 1)]
    kept = J.one_of_each(docs)
    assert kept.columns == docs.columns
    # the row without an id is a copy of document 1
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "7", "8"]
    assert J.near_duplicates(cases.empty(spark)).count() == J.one_of_each(cases.empty(spark)).count() == 0


def test_one_of_each_goes_by_row_not_by_id(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "red green blue white black grey")
    rows = [(2, a), (1, a), (1, b), (3, b), (4, c), (None, c), (None, "no copy of anything at all"), (None, a), (None, "x y z"),
            (None, "X Y Z"), (5, None), (5, None), (6, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as nth", "2 as text_key", "3 as in_group")
    kept = J.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in kept.collect()), key=str)
    # where one id has two texts both may stay; empty texts are in no group
    want = [(1, a), (1, b), (4, c), (0, "no copy of anything at all"), (5, None), (5, None), (6, " ")]
    xyz = [g for g in got if g[1] in ("x y z", "X Y Z")]
    assert len(xyz) == 1 and sorted((g for g in got if g not in xyz), key=str) == sorted(want, key=str)


def test_linked_sets_share_as_many_points_as_is_asked():
    rng = np.random.default_rng(12)
    met = 0
    for num, den in ((8, 10), (9, 10), (5, 10)):
        threshold = J.Threshold(num, den)
        for n in [2, 5, 9, 14, 30, 90, 400, 3000] * 12:
            a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            out = rng.integers(0, threshold.most(2 * len(a)) + 1)
            b = np.unique(np.concatenate([a[out // 2:], rng.integers(0, 1 << 64, out - out // 2, dtype=np.uint64)]))
            if not threshold.links(len(np.intersect1d(a, b)), len(a), len(b)) or len(a) == len(np.intersect1d(a, b)) == len(b):
                continue
            met += 1
            (x, need_x), (y, need_y) = J.agreements(a, threshold), J.agreements(b, threshold)
            shared = np.intersect1d(x, y)
            enough = False
            for grid in set((shared & J.GRID_BITS).tolist()):
                count = (shared & J.GRID_BITS == grid).sum()
                enough |= count >= need_x[x & J.GRID_BITS == grid].max() and count >= need_y[y & J.GRID_BITS == grid].max()
            assert enough, (num, n, out)
    assert met > 100


def test_sketches_part_no_link():
    rng = np.random.default_rng(9)
    threshold = J.Threshold(8, 10)
    linked = parted = 0
    for n in [1, 3, 9, 30, 100, 700, 5000] * 20:
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        keep = rng.random(len(a)) < rng.choice([0.99, 0.9, 0.85, 0.5, 0.1])
        b = np.unique(np.concatenate([a[keep], rng.integers(0, 1 << 63, int((~keep).sum() * rng.choice([0.2, 1])), dtype=np.uint64)]))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        found = J.may_link([len(a), len(b)], [J.sketch(a), J.sketch(b)], threshold)
        if threshold.links(both, len(a), len(b)):
            linked += 1
            assert found == [(0, 1)]
        parted += not found
    assert linked > 20 and parted > 20
    many = [np.unique(rng.integers(0, 1 << 40, 60, dtype=np.uint64)) for _ in range(5)]
    assert len(J.may_link([len(s) for s in many] * 2, [J.sketch(s) for s in many] * 2, threshold)) >= 5
