"""Splits, subsets, folds and samples (FLT-01..07, WN-10/11).

Null years: pandas keeps a null year in ``year != 2024``; SQL three-valued
logic would drop it, so the train side uses ``NOT (year <=> 2024)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailfold.functions.ranking import position_within

EVAL_YEAR = 2024


def is_eval_year(year: str = "year", eval_year: int = EVAL_YEAR) -> Column:
    return F.coalesce(F.col(year) == eval_year, F.lit(False))


def temporal_split(labels: DataFrame, eval_year: int = EVAL_YEAR) -> DataFrame:
    """FLT-01: ``train`` = not test and year ≠ eval year (null kept); ``eval`` = year = eval year."""
    train = ~F.col("test") & ~F.col("year").eqNullSafe(eval_year)
    split = F.when(is_eval_year("year", eval_year), "eval").when(train, "train")
    return labels.withColumn("split", split).where(F.col("split").isNotNull())


def official_split(labels: DataFrame) -> DataFrame:
    """FLT-02: split by the ``test`` flag."""
    return labels.withColumn("split", F.when(F.col("test"), "test").otherwise("train"))


def history_pool(labels: DataFrame, mode: str = "temporal", eval_year: int = EVAL_YEAR) -> DataFrame:
    """FLT-04: retrieval pool — not test and (temporal mode) year strictly before the eval year.

    A null year is excluded (it cannot be shown to precede the cohort).
    """
    pool = ~F.col("test")
    if mode != "official_test":
        pool = pool & F.coalesce(F.col("year") < eval_year, F.lit(False))
    return labels.where(pool)


def eval_subset(labels: DataFrame, mode: str, per_class: int = 10, seed: int = 42,
                order: list | None = None) -> DataFrame:
    """FLT-03: evaluation subset by mode ``2024 | dev_2023 | official_test | pilot_20``."""
    if mode == "2024":
        return labels.where(is_eval_year("year", 2024))
    if mode == "dev_2023":
        return labels.where(is_eval_year("year", 2023))
    if mode == "official_test":
        return labels.where(F.col("test"))
    if mode == "pilot_20":
        return balanced_sample(labels.where(is_eval_year("year", 2024)), per_class, seed, order=order)
    raise ValueError(f"unknown split mode {mode!r}")


def first_n(df: DataFrame, n: int, key: str = "experiment") -> DataFrame:
    """FLT-07: the first ``n`` rows by ``key`` (a limit is the feature here)."""
    return df.orderBy(key).limit(n)


def shuffle_key(key: str, seed: int) -> Column:
    """Seeded, reproducible pseudo-random order key."""
    return F.xxhash64(F.col(key).cast("string"), F.lit(seed))


def stratified_folds(df: DataFrame, k: int = 10, label: str = "label", order: list | None = None,
                     key: str = "experiment", seed: int = 1) -> DataFrame:
    """WN-10: ``fold = (position in class by shuffled order − 1) % k``.

    Balanced per class within one row; positions come from
    ``position_within`` (no single-task window over a class).
    """
    order = order or [shuffle_key(key, seed), F.col(key)]
    p = position_within(df, [label], order, out="_pos")
    return p.withColumn("fold", ((F.col("_pos") - 1) % k).cast("int")).drop("_pos")


def balanced_sample(df: DataFrame, n: int, seed: int = 42, label: str = "label",
                    key: str = "experiment", order: list | None = None) -> DataFrame:
    """WN-11: ``n`` rows per class in seeded order (top-n per class, a window group limit)."""
    w = Window.partitionBy(label).orderBy(*(order or [shuffle_key(key, seed), F.col(key)]))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
