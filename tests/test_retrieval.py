"""Exact tiled k-NN against numpy brute force; leak guards."""

import numpy as np
import pytest

from trailfold.operators import angular, retrieval


def _brute(t, p, tid, pid, k):
    def unit(x):
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    d = 1.0 - unit(t) @ unit(p).T
    out = {}
    for i, a in enumerate(tid):
        cand = sorted((round(d[i, j], 12), b) for j, b in enumerate(pid) if b != a)
        out[a] = [b for _, b in cand[:k]]
    return out


def test_tiled_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    t = rng.normal(size=(23, 5))
    p = rng.normal(size=(41, 5))
    p[0] = 0.0                                     # zero vector: distance 1 to everything
    tid = list(range(100, 123))
    pid = list(range(0, 41))
    tdf = spark.createDataFrame([(i, v.tolist()) for i, v in zip(tid, t)], "id long, vec array<double>")
    pdf = spark.createDataFrame([(i, v.tolist()) for i, v in zip(pid, p)], "id long, vec array<double>")
    got = retrieval.knn_topk(tdf, pdf, k=3, tile_rows=7).collect()   # several tiles on both sides
    by = {}
    for r in sorted(got, key=lambda r: (r.target_id, r.rank)):
        by.setdefault(r.target_id, []).append(r.neighbor_id)
    assert by == _brute(t, p, tid, pid, 3)


def test_zero_vector_and_self_exclusion(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = retrieval.knn_topk(df, df, k=2).collect()
    assert all(r.target_id != r.neighbor_id for r in got)
    z = [r for r in got if r.target_id == 1]
    assert all(r.distance == 1.0 for r in z)


def test_leak_audit_counts_violations(spark):
    nb = spark.createDataFrame([(10, 1, 1), (10, 2, 2), (10, 3, 3)], "target_id long, rank int, neighbor_id long")
    years = spark.createDataFrame([(1, 2020), (2, 2024), (3, None)], "id long, year int")
    assert retrieval.leak_audit(nb, years).first().n_violations == 2


def test_duplicate_vectors_emit_k_per_target(spark):
    rows = [(i, [1.0, 2.0]) for i in range(50)]          # every pair ties
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = retrieval.knn_topk(df, df, k=3, tile_rows=16).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.target_id, r.rank)):
        by.setdefault(r.target_id, []).append(r.neighbor_id)
    assert len(by) == 50 and all(len(v) == 3 for v in by.values())
    assert by[0] == [1, 2, 3] and by[5] == [0, 1, 2]      # ties broken by the smaller id


def test_text_ids(spark):
    rows = [("a1f", [1.0, 0.0]), ("b2e", [0.9, 0.1]), ("c", [0.0, 1.0]), ("d", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, vec array<double>")
    got = {(r.target_id, r.rank): r.neighbor_id for r in retrieval.knn_topk(df, df, k=2, tile_rows=2).collect()}
    assert got["a1f", 1] == "d" and got["a1f", 2] == "b2e" and got["c", 1] == "b2e"
    nb = retrieval.knn_topk(df.limit(1), df, k=1)
    assert retrieval.leak_audit(nb, spark.createDataFrame([("d", 2025)], "id string, year int")).first().n_violations == 1
    labels = spark.createDataFrame([("d", "benign")], "id string, label string")
    assert retrieval.knn_vote(nb, labels).first().predicted_label == "benign"


def _by_target(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r.target_id, r.rank)):
        by.setdefault(r.target_id, []).append(r.neighbor_id)
    return by


@pytest.mark.parametrize("shape", ["clustered", "spread", "one hot vector"])
def test_pruned_tiles_are_exact(spark, shape):
    rng = np.random.default_rng(5)
    if shape == "clustered":
        p = np.repeat(rng.normal(size=(30, 8)), 20, axis=0) + rng.normal(size=(600, 8)) * 0.01
    else:
        p = rng.normal(size=(600, 8))
    if shape == "one hot vector":
        p[:250] = p[0]                                     # a third and more of all rows alike: ties by id
    p[7] = 0.0
    t = np.vstack([p[::9] + (rng.normal(size=p[::9].shape) * 0.001 if shape != "one hot vector" else 0), np.zeros((1, 8)), -p[3:4]])
    ids = list(range(600, 600 + len(t)))
    ids[:5] = [0, 9, 18, 27, 36]                           # targets that are in the pool themselves
    tdf = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, t)], "id long, vec array<double>")
    pdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(p)] + [(999, [float("nan")] * 8), (998, [float("inf")] * 8)],
                                "id long, vec array<double>")
    got = _by_target(retrieval.knn_topk(tdf, pdf, k=4, tile_rows=40).collect())
    assert got == _brute(t, p, ids, list(range(600)), 4)
    n = retrieval.pairs_visited(tdf, pdf, k=4, tile_rows=40).first()
    assert (n.n_targets, n.n_pool) == (len(t), 602) and n.n_visited <= len(t) * 600
    if shape == "clustered":
        assert n.n_visited < 0.35 * len(t) * 600           # what is left: the zero vector, far targets


def test_pruned_knn_of_few_or_no_directions(spark):
    nan = [float("nan"), 1.0]
    pool = spark.createDataFrame([(i, nan) for i in range(9)], "id long, vec array<double>")
    target = spark.createDataFrame([(50, [1.0, 0.0]), (51, nan)], "id long, vec array<double>")
    assert retrieval.knn_topk(target, pool, k=2, tile_rows=4).count() == 0
    pool = pool.unionByName(spark.createDataFrame([(90, [2.0, 0.1])], pool.schema))
    assert [r.neighbor_id for r in retrieval.knn_topk(target, pool, k=2, tile_rows=4).collect()] == [90]
    assert retrieval.knn_topk(target.limit(0), pool, k=2, tile_rows=4).count() == 0


def test_blocks_of_homes():
    assert angular.blocks_of_homes({0: 3, 2: 4, 3: 9, 5: 1, 6: 8}, 8) == [(0, 0, 1), (2, 0, 1), (3, 1, 2), (5, 3, 1), (6, 4, 1)]
