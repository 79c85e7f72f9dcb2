"""Forests that grow in tasks: cuts, trees, and the same job as MLlib's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailfold.operators import forests, models

ALL = ("experiment", "label")


def _rows(spark, n=300, missing=False):
    rng = np.random.default_rng(3)
    rows = [(None if i % 50 == 0 else str(i // 2), "malicious" if rng.random() < (0.85 if i % 4 < 2 else 0.1) else "benign",
             float(i % 4 + rng.random()), None if missing and i == 7 else float(rng.integers(5)), i % 3 == 0, i % 3) for i in range(n)]
    return rows, spark.createDataFrame(rows, "experiment string, label string, a double, b double, test boolean, fold int")


def _gini(y, w):
    p = (y * w).sum() / w.sum()
    return w.sum() * 2 * p * (1 - p)


def test_cuts_lie_between_values():
    assert forests.thresholds(np.array([3.0, 1.0, 1.0, 2.0, 7.0]), 64).tolist() == [1.5, 2.5, 5.0]
    assert forests.thresholds(np.array([4.0, 4.0]), 64).tolist() == []
    many = forests.thresholds(np.arange(1000.0), 64)
    assert len(many) <= 63 and (np.diff(many) > 0).all() and np.diff(many).max() < 20


def test_a_tree_takes_the_best_cut_and_ends_in_pure_leaves():
    rng = np.random.default_rng(8)
    codes = rng.permutation(64).astype(np.uint8)[None, :]
    y = ((codes[0] > 20) ^ (rng.random(64) < 0.2)).astype(np.uint8)
    weights = rng.poisson(1.0, (3, 64)).astype(np.uint8)
    trees = forests.grow(codes, y, weights, 30, 64, rng)
    for root in range(3):
        w = weights[root].astype(float)
        drawn = sorted(codes[0][w > 0])[:-1]
        left = {c: _gini(y[codes[0] <= c], w[codes[0] <= c]) + _gini(y[codes[0] > c], w[codes[0] > c]) for c in drawn}
        assert left[trees[1][root]] == pytest.approx(min(left.values()))
        drawn = w > 0
        # three times the same tree: each row by itself
        only = forests.grow(codes, y, weights[root:root + 1], 30, 64, np.random.default_rng(1))
        says = forests.votes(only, 1, codes)[drawn]
        assert ((says > 0.5) == (y[drawn] == 1)).all()
    stump = forests.grow(codes, y, weights, 1, 64, rng)
    assert len(stump[0]) <= 9 and (stump[0][3:] == -1).all()


def test_two_leaves_of_one_decision_are_one():
    codes = np.array([[0] * 10 + [1] * 10], np.uint8)
    y = np.array([0] * 10 + [0] * 9 + [1], np.uint8)
    trees = forests.grow(codes, y, np.ones((1, 20), np.uint8), 30, 64, np.random.default_rng(0))
    assert trees[0][0] == -1
    assert forests.votes(trees, 1, codes) == pytest.approx([0.05] * 20)


def test_large_forests_grow_in_tasks(spark, monkeypatch):
    """No fit a part: rows with one key, without a key and of both classes are scored once, about as MLlib does."""
    rows, df = _rows(spark)
    monkeypatch.setattr(models, "ROW_TREES", 300 * 12)
    train, test, forest = df.where(~F.col("test")), df.where(F.col("test")), models.forest(["a", "b"], trees=60)
    with monkeypatch.context() as m:
        m.setattr(models, "_fit_and_score", None)
        got = models.fit_predict(train, test, forest, ["experiment", "label", "a"]).collect()
        again = models.fit_predict(train.repartition(3), test, forest, ["experiment", "label", "a"]).collect()
    order = lambda r: r.a
    assert sorted((r.a, r.experiment or "", r.label) for r in got) == sorted((r[2], r[0] or "", r[1]) for r in rows if r[4])
    assert sorted(got, key=order) == sorted(again, key=order)
    monkeypatch.setattr(forests, "TABLE_BYTES", 0)
    theirs = models.fit_predict(train, test, forest, ["experiment", "label", "a"]).collect()
    mine, theirs = ([r.malware_probability for r in sorted(x, key=order)] for x in (got, theirs))
    assert np.corrcoef(mine, theirs)[0, 1] > 0.9 and abs(np.mean(mine) - np.mean(theirs)) < 0.05


def test_folds_are_scored_by_forests_of_the_others(spark, monkeypatch):
    """Labels that only a row itself could tell are not found out of fold."""
    rows = [(str(i), "malicious" if hash((i * 7919 % 1009) % 2) else "benign", float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "experiment string, label string, a double")
    monkeypatch.setattr(models, "ROW_TREES", 400 * 12)
    monkeypatch.setattr(models, "_fit_and_score", None)
    got = models.out_of_fold(df, models.forest(["a"], trees=30), ["experiment", "label"], k=4)
    assert got.columns == ["experiment", "label", "fold", "prediction", "malware_probability"]
    got = got.collect()
    assert sorted(r.experiment for r in got) == sorted(r[0] for r in rows)
    assert sum(r.prediction == r.label for r in got) < 320
    assert all((r.malware_probability >= 0.5) == (r.prediction == "malicious") for r in got)


def test_variants_share_one_table(spark, monkeypatch):
    rows, df = _rows(spark)
    monkeypatch.setattr(models, "ROW_TREES", 300 * 12)
    monkeypatch.setattr(models, "_fit_and_score", None)
    out = dict(models.ablation(df, {"B": ["b"]}, base=["a"], trees=40))
    assert list(out) == ["baseline", "+B", "full"]
    for pred in out.values():
        got = pred.collect()
        assert sorted((r.experiment or "", r.label) for r in got) == sorted((r[0] or "", r[1]) for r in rows if r[4])
        assert sum(r.prediction == r.label for r in got) / len(got) > 0.75


def test_missing_features_and_labels_are_refused_as_before(spark, monkeypatch):
    _, df = _rows(spark, missing=True)
    monkeypatch.setattr(models, "ROW_TREES", 300 * 12)
    forest = models.forest(["a", "b"], trees=30)
    with pytest.raises(Exception, match="NaN"):
        models.fit_predict(df.where(~F.col("test")), df.where(F.col("test")), forest, ["experiment"]).collect()
    nameless = df.fillna(1.0, ["b"]).withColumn("label", F.when(F.col("a") > 1, F.col("label")))
    with pytest.raises(Exception, match="(?i)null"):
        models.fit_predict(nameless.where(~F.col("test")), nameless.where(F.col("test")), forest, ["experiment"]).collect()
