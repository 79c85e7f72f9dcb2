"""MLlib wrappers: class order, decision rules, cascade bands."""

from pyspark.sql import functions as F

from trailfold.operators import cascade, models


def test_class_order_and_learning(spark):
    rows = [(str(i), "malicious" if i % 2 else "benign", float(i % 2) * 10 + (i % 3), float(i % 5), i % 3 == 0)
            for i in range(120)]
    df = spark.createDataFrame(rows, "experiment string, label string, a double, b double, test boolean")
    idx = models.label_indexer().fit(df)
    assert list(idx.labels) == ["benign", "malicious"]
    p = models.fit_predict(df.where(~F.col("test")), df.where(F.col("test")),
                           models.forest(["a", "b"], trees=20), ["experiment", "label"])
    rows = p.collect()
    acc = sum(r.label == r.prediction for r in rows) / len(rows)
    assert acc > 0.9
    assert all((r.malware_probability > 0.5) == (r.prediction == "malicious") or r.malware_probability == 0.5
               for r in rows)


def test_threshold_vs_argmax_tie(spark):
    """A tie of one half: the class argmax says benign (the first class), the threshold malicious."""
    from pyspark.ml.linalg import Vectors

    class Fixed:
        def transform(self, df):
            return df

    df = spark.createDataFrame([("t", Vectors.dense(0.5, 0.5), 0.0), ("m", Vectors.dense(0.2, 0.8), 1.0)],
                               ["experiment", "probability", "prediction"])
    by = {rule: {r.experiment: r.prediction for r in models.predictions(Fixed(), df, ["experiment"], rule).collect()}
          for rule in ("argmax", "threshold")}
    assert by == {"argmax": {"t": "benign", "m": "malicious"}, "threshold": {"t": "malicious", "m": "malicious"}}


def test_stacking_scores_every_row_out_of_fold(spark):
    rows = [(str(i), "malicious" if i % 2 else "benign", float(i % 2) * 0.6 + (i % 7) / 20, None if i % 11 == 0 else 0.5, i % 5)
            for i in range(100)]
    df = spark.createDataFrame(rows, "experiment string, label string, p1 double, p2 double, fold int")
    some = cascade.stack_out_of_fold(df, ["p1", "p2"], 5, ["experiment", "label", "fold"]).collect()
    assert sorted(r.experiment for r in some) == sorted(r[0] for r in rows)
    assert {r.experiment for r in some if r.p_stack is None} == {r[0] for r in rows if r[3] is None}
    filled = cascade.stack_out_of_fold(df, ["p1", "p2"], 5, ["experiment", "label", "fold"], missing=0.5).collect()
    assert all(0 <= r.p_stack <= 1 for r in filled) and len(filled) == 100


def test_cascade_bands_inclusive(spark):
    rows = [(0.04, 0.5), (0.96, 0.5), (0.5, 0.34), (0.5, 0.66), (0.5, 0.35), (0.5, 0.65), (0.05, 0.5), (0.95, 0.5)]
    df = spark.createDataFrame(rows, "p_fast double, p_ens double").withColumn("experiment", F.lit("x"))
    out = [r.decision for r in cascade.cascade(df, "p_fast", ["p_ens"]).collect()]
    assert out == ["benign", "malicious", "benign", "malicious", "triage", "triage", "triage", "triage"]


def test_sparse_vectors_from_entries(spark):
    from pyspark.ml.linalg import Vectors
    rows = [("a", [(0, 1.5), (7, 2.0)]), ("b", []), ("c", None)]
    df = spark.createDataFrame(rows, "experiment string, e array<struct<idx:int,w:double>>")
    got = {r.experiment: r.features for r in models._as_vectors(df, "e", 9).collect()}
    assert got == {"a": Vectors.sparse(9, [0, 7], [1.5, 2.0]), "b": Vectors.sparse(9, [], []), "c": Vectors.sparse(9, [], [])}
    assert all(type(v).__name__ == "SparseVector" for v in got.values())


def test_large_forests_grow_in_parts(spark, monkeypatch):
    """A forest beyond ROW_TREES grows in parts: all trees, each row scored once, nulls and repeated keys kept."""
    rows = [(None if i % 50 == 0 else str(i // 2), "malicious" if i % 2 else "benign", float(i % 2) * 10 + (i % 3), float(i % 5), i % 3 == 0)
            for i in range(120)]
    df = spark.createDataFrame(rows, "experiment string, label string, a double, b double, test boolean")
    train, test = df.where(~F.col("test")), df.where(F.col("test"))
    forest = models.forest(["a", "b"], trees=20)
    assert [n for _, n in models.forest_parts(forest, 80)] == [20]
    monkeypatch.setattr(models, "ROW_TREES", 80 * 12)
    parts = models.forest_parts(forest, 80)
    assert [n for _, n in parts] == [2] * 10
    assert len({p.getStages()[-1].getSeed() for p, _ in parts}) == len(parts)
    assert [p.getStages()[-1].getNumTrees() for p, _ in parts] == [n for _, n in parts]
    assert forest.getStages()[-1].getNumTrees() == 20
    most, growing = 0, []
    fit_and_score = models._fit_and_score

    def watched(pipeline, *rest):
        nonlocal most
        growing.append(pipeline.getStages()[-1].getNumTrees())
        most = max(most, sum(growing))
        fit_and_score(pipeline, *rest)
        growing.pop()
    monkeypatch.setattr(models, "_fit_and_score", watched)
    key = lambda r: (r[0] or "", r[1])
    got = models.fit_predict(train, test, forest, ["experiment", "label"]).collect()
    assert most <= 12
    assert sorted(((r.experiment, r.label) for r in got), key=key) == sorted(((r[0], r[1]) for r in rows if r[4]), key=key)
    assert sum(r.label == r.prediction for r in got) / len(got) > 0.9
    assert all(0 <= r.malware_probability <= 1 for r in got)
    scored = models.out_of_fold(df, forest, ["experiment", "label"], k=4).collect()
    assert sorted(((r.experiment, r.label) for r in scored), key=key) == sorted(((r[0], r[1]) for r in rows), key=key)
    assert all((r.malware_probability >= 0.5) == (r.prediction == "malicious") for r in scored)
