"""Splits, folds and exact in-group positions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from trailfold.functions.ranking import position_within
from trailfold.operators import splits

LAB = "experiment string, label string, year int, test boolean"


def test_null_year_kept_in_train_excluded_from_pool(spark):
    df = spark.createDataFrame([("a", "benign", None, False), ("b", "benign", 2024, False),
                                ("c", "malicious", 2023, True), ("d", "benign", 2020, False)], LAB)
    s = {r.experiment: r.split for r in splits.temporal_split(df).collect()}
    assert s == {"a": "train", "b": "eval", "d": "train"}
    assert {r.experiment for r in splits.history_pool(df).collect()} == {"d"}


def test_folds_balanced_and_in_range(spark):
    rows = [(str(i), "malicious" if i % 3 == 0 else "benign", 2020, False) for i in range(257)]
    f = splits.stratified_folds(spark.createDataFrame(rows, LAB), 10)
    c = f.groupBy("label", "fold").count().collect()
    for lab in ("benign", "malicious"):
        ns = [r["count"] for r in c if r.label == lab]
        assert len(ns) == 10 and max(ns) - min(ns) <= 1
    assert f.where((F.col("fold") < 0) | (F.col("fold") > 9)).count() == 0


def test_position_within_equals_row_number(spark):
    df = spark.range(0, 3000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1009).alias("o"),
                                     F.col("id"))
    got = position_within(df.repartition(7), ["g"], [F.col("o"), F.col("id")])
    w = Window.partitionBy("g").orderBy("o", "id")
    ref = df.withColumn("rn", F.row_number().over(w))
    diff = got.join(ref, ["g", "o", "id"]).where(F.col("pos") != F.col("rn")).count()
    assert diff == 0 and got.count() == 3000


def test_balanced_sample(spark):
    rows = [(str(i), "malicious" if i % 4 == 0 else "benign", 2024, False) for i in range(200)]
    s = splits.balanced_sample(spark.createDataFrame(rows, LAB), 10)
    assert sorted(r["count"] for r in s.groupBy("label").count().collect()) == [10, 10]
