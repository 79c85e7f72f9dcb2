"""Protocol and data-quality checks (DQ-01..09): one row ``check, n_violations``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailfold.schemas import LABELS


def _one(df: DataFrame, name: str, violations) -> DataFrame:
    return df.agg(violations.cast("long").alias("n_violations")).select(
        F.lit(name).alias("check"), "n_violations")


def dup_keys(df: DataFrame, key: str = "experiment", name: str = "dup_keys") -> DataFrame:
    """DQ-01: keys occurring more than once (count of such keys)."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    return _one(g, name, F.count_if(F.col("c") > 1))


def label_domain_check(df: DataFrame, label: str = "label") -> DataFrame:
    """DQ-02: labels outside {benign, malicious} plus domain values never seen."""
    seen = df.select(F.col(label).alias("v")).distinct()
    dom = df.sparkSession.createDataFrame([(x,) for x in LABELS], "v string")
    extra = seen.join(dom, "v", "left_anti")
    missing = dom.join(seen, "v", "left_anti")
    return _one(extra.select("v").unionByName(missing.select("v")), "label_domain", F.count(F.lit(1)))


def missing_features(labels: DataFrame, features: DataFrame, key: str = "experiment") -> DataFrame:
    """DQ-03 / JN-07: labeled experiments without a feature row."""
    return labels.join(features.select(key), key, "left_anti")


def finite_check(df: DataFrame, cols: list[str]) -> DataFrame:
    """DQ-04: rows with a NaN/±inf/null value in any of ``cols``."""
    bad = None
    for c in cols:
        x = F.col(c).cast("double")
        b = x.isNull() | F.isnan(x) | (x == float("inf")) | (x == float("-inf"))
        bad = b if bad is None else (bad | b)
    return _one(df, "finite", F.count_if(bad))


def cohort_sizes(df: DataFrame, expected: dict[str, int], by: str = "split") -> DataFrame:
    """DQ-05: ``split, n, expected, ok``."""
    exp = df.sparkSession.createDataFrame(list(expected.items()), f"{by} string, expected long")
    got = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return (exp.join(got, by, "left")
            .select(by, F.coalesce("n", F.lit(0)).alias("n"), "expected",
                    (F.coalesce("n", F.lit(0)) == F.col("expected")).alias("ok")))


def fold_range_check(df: DataFrame, k: int = 10, fold: str = "fold") -> DataFrame:
    """DQ-06: fold ids outside 0..k-1."""
    return _one(df, "fold_range", F.count_if(F.col(fold).isNull() | (F.col(fold) < 0) | (F.col(fold) >= k)))


def hash_format_check(df: DataFrame, col: str = "prompt_hash") -> DataFrame:
    """DQ-08: prompt hashes that are not 64 lowercase hex characters."""
    return _one(df, "hash_format", F.count_if(~F.coalesce(F.col(col).rlike("^[0-9a-f]{64}$"), F.lit(False))))


def one_to_one_check(left: DataFrame, right: DataFrame, key: str = "experiment") -> DataFrame:
    """JN-02: keys duplicated on either side of a join meant to be one-to-one."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(key)
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(key)
    return _one(a.unionByName(b).distinct(), "one_to_one", F.count(F.lit(1)))
