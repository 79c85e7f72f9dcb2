"""Nearest neighbours against brute force."""

from collections import defaultdict

import llm_cases as cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from trailfold.llm import nearest
from trailfold.llm.common import table


def brute(rows, k, queries):
    """{query: [(id, score)]} by all products in double precision, ties to the smaller id."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for q in queries:
        score = x @ x[np.flatnonzero(ids == q)[0]]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return dict(out)


def recall(got, want):
    hits = [len({i for i, _ in got[q]} & {i for i, _ in w}) / max(1, len(w)) for q, w in want.items()]
    return sum(hits) / len(hits)


def test_leaves_and_queue_agree():
    rng = np.random.default_rng(1)
    sample = rng.normal(size=(2000, 12))
    forest = nearest.grow(sample, np.arange(2000), 2000, float((sample ** 2).sum(axis=1).max()), 10, trees=4, leaf=100)
    assert forest.depth == 5 and np.allclose(forest.share.sum(axis=1), 1)
    filed = forest.leaves(sample)
    for t in range(4):
        assert np.allclose(np.bincount(filed[:, t], minlength=32) / 2000, forest.share[t])
    order, seen = forest.queue(sample[:50])
    assert (np.sort(order, axis=1) == np.arange(order.shape[1])).all() and np.allclose(seen[:, -1], 4)


@pytest.mark.parametrize("spread", [1.0, 0.05])
def test_recall_of_loose_and_tight_vectors(spark, spread):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 3000)] + spread * rng.normal(size=(3000, 16))).astype(np.float32)
    x *= rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)            # lengths differ: products are not angles
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(nearest.search(df, F.col("vec_id") % 60 == 0, 10, leaf=64))
    want = brute(rows, 10, range(0, 3000, 60))
    assert all(len(got[q]) == 10 for q in want) and recall(got, want) >= 0.9
    ids = dict(rows)
    for q, pairs in got.items():
        assert [s for _, s in pairs] == sorted((s for _, s in pairs), reverse=True)
        for i, s in pairs:
            assert abs(s - float(np.array(ids[i]) @ np.array(ids[q]))) < 1e-9


def test_one_vector_in_a_third_of_all_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(nearest.search(df, F.col("vec_id") % 20 == 0, 20, leaf=32))
    want = brute(rows, 20, range(0, 900, 20))
    assert recall(got, want) >= 0.9
    assert [i for i, _ in got[0]] == [3 * i for i in range(1, 21)] and [i for i, _ in got[60]] == [3 * i for i in range(20)]


@pytest.mark.parametrize("n", [20, 21, 1500])
def test_no_true_neighbour_is_dropped_where_all_points_are_sampled(spark, n):
    x = np.random.default_rng(6).normal(size=(n, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(nearest.search(df, F.lit(True), 20, leaf=2048))       # one leaf: all others are candidates
    want = brute(rows, 20, range(n))
    assert {q: len(p) for q, p in got.items()} == dict.fromkeys(range(n), min(20, n - 1))
    assert all([i for i, _ in got[q]] == [i for i, _ in w] for q, w in want.items())


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0], "a"), (0, [1.0, 0.0], "a"), (1, [0.5, 0.5], "b"), (2, [0.0, 0.0], "c"), (3, None, "d"),
            (4, [1.0, None], "e"), (5, [float("nan"), 1.0], "f"), (6, [float("inf"), 1.0], "g"), (None, [9.0, 9.0], "h"),
            (20, [1.0, 2.0, 3.0], "i"), (40, [0.5, 0.5], "j"), (60, [], "k"), (7, [-1.0, 0.0], "l")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string").withColumn("score", F.lit("x"))
    got = found(nearest.search(df, F.col("vec_id") % 20 == 0))
    assert got == {0: [(1, 0.5), (40, 0.5), (7, -1.0)], 40: [(0, 0.5), (1, 0.5), (7, -0.5)]}
    assert nearest.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest.search(df.filter("vec_id = 1"), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest.search(df.filter("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.skipif(not cases.HAVE_SF, reason="driver test data not present")
def test_recall_of_embeddings(spark):
    df = table(spark, cases.SF, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()]
    got = found(nearest.search(df, F.col("vec_id") % 20 == 0))
    want = brute(rows, 20, [i for i, _ in rows if i % 20 == 0])
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
