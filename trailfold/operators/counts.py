"""Event counting: per-rule counts, the wide feature matrix, shard profiles.

All of these are hash aggregates with map-side partial aggregation, so a hot
experiment (one key holding a large share of all events) is pre-combined in
every scan task before the shuffle — no single task ever sees its raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailfold.schemas import FEATURES


def rule_counts(trace: DataFrame) -> DataFrame:
    """AG-01: ``experiment, rule, n`` — events per (experiment, rule)."""
    return (trace.groupBy("experiment", F.col("RuleName").alias("rule"))
            .agg(F.count(F.lit(1)).alias("n")))


def feature_counts(trace: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """AG-02: counter -> wide columns, one column per feature rule.

    Expressed as conditional counts in one aggregate (equivalent to a pivot
    with explicit values, but a single partial+final hash aggregate instead of
    an aggregate followed by a pivot-first aggregate).  Rules outside
    ``features`` are dropped, as the 9-column projection does.
    """
    aggs = [F.count_if(F.col("RuleName") == f).alias(f) for f in features]
    return trace.groupBy("experiment").agg(*aggs)


def feature_matrix(trace: DataFrame, labels: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """JN-01 + PRJ-01/02: counts joined to labels, missing counts as 0.

    Inner join on ``experiment``.  Both sides hold one row per experiment, so
    neither is broadcast by hint: AQE switches to a broadcast join at run time
    when the measured shuffle output of a side is under the threshold.
    """
    counts = feature_counts(trace, features)
    j = counts.join(labels.select("experiment", "year", "label", "test"), "experiment", "inner")
    return j.fillna(0, subset=features).select("experiment", *features, "year", "label", "test")


def rule_map(trace: DataFrame) -> DataFrame:
    """AG-03: counter as ``MAP<rule, count>`` per experiment."""
    rc = rule_counts(trace)
    return rc.groupBy("experiment").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "n")))).alias("rule_counts"))


def rule_counts_ranked(trace: DataFrame) -> DataFrame:
    """ST-01: rule counts in descending order, ties in first-seen order.

    Returns ``experiment, rank, rule, n, first_seq``; the rank is computed on
    the (at most 10-row) per-experiment counter, never on raw events.
    """
    rc = (trace.groupBy("experiment", F.col("RuleName").alias("rule"))
          .agg(F.count(F.lit(1)).alias("n"), F.min("ingest_seq").alias("first_seq")))
    from pyspark.sql import Window
    w = Window.partitionBy("experiment").orderBy(F.desc("n"), F.asc("first_seq"))
    return rc.withColumn("rank", F.row_number().over(w))


def shard_profile(trace: DataFrame) -> DataFrame:
    """AG-24: per shard — events, experiments, distinct parents/children, time range."""
    return trace.groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_distinct("experiment").alias("experiments"),
        F.count_distinct("parent_guid", "experiment").alias("distinct_parents"),
        F.count_distinct("child_guid", "experiment").alias("distinct_children"),
        F.count_distinct("parent_name").alias("distinct_parent_names"),
        F.count_distinct("child_name").alias("distinct_child_names"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )


def experiment_profile(trace: DataFrame) -> DataFrame:
    """AG-24 per experiment: events, and how many different rules, processes and names."""
    return trace.groupBy("shard_id", "experiment").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("RuleName").alias("rules"),
        F.count_distinct("parent_guid").alias("parents"), F.count_distinct("child_guid").alias("children"),
        F.count_distinct("child_name").alias("child_names"),
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


def shard_rule_profile(trace: DataFrame) -> DataFrame:
    """AG-24 value counts: ``shard_id, rule, n``."""
    return trace.groupBy("shard_id", F.col("RuleName").alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def shard_span_check(trace: DataFrame) -> DataFrame:
    """AG-25: experiments spread over more than one shard (0 expected)."""
    spans = trace.groupBy("experiment").agg(F.count_distinct("shard_id").alias("shards"))
    return spans.agg(F.lit("shard_span").alias("check"),
                     F.count_if(F.col("shards") > 1).alias("n_violations"))
