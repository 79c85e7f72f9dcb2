"""The trace folded once by process and rule, and once by experiment, for all operators that count.

Actions, breakdowns, fan-out and root attribution need no single event, only
counts and first positions per (experiment, parent, rule); bounds, roots and
totals only one row per experiment.  Each fold is one scan with partial
aggregation, so a hot experiment is pre-combined in every scan task, and is
written once per trace DataFrame.
"""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailfold.session import checkpoint_dir, materialize

_FOLDS: "weakref.WeakKeyDictionary[DataFrame, DataFrame]" = weakref.WeakKeyDictionary()


def by_process(trace: DataFrame) -> DataFrame:
    """``experiment, parent_guid, rule, n, first_seq, children`` (edges: created processes with a name)."""
    hit = _FOLDS.get(trace)
    if hit is None:
        checkpoint_dir(trace.sparkSession)
        edge = (F.col("RuleName") == "process_create") & F.col("child_guid").isNotNull()
        hit = materialize(trace.groupBy("experiment", "parent_guid", F.col("RuleName").alias("rule")).agg(
            F.count(F.lit(1)).alias("n"), F.min("ingest_seq").alias("first_seq"), F.count_if(edge).alias("children")))
        _FOLDS[trace] = hit
    return hit


_TOTALS: "weakref.WeakKeyDictionary[DataFrame, DataFrame]" = weakref.WeakKeyDictionary()


def by_experiment(trace: DataFrame) -> DataFrame:
    """``experiment, total_events, first_us, last_us, last_seq, shard_id, root_guid`` (WN-04 for the root)."""
    hit = _TOTALS.get(trace)
    if hit is None:
        checkpoint_dir(trace.sparkSession)
        at, det = F.unix_micros("timestamp"), F.col("RuleName") == "detonation"
        a = trace.groupBy("experiment").agg(
            F.count(F.lit(1)).alias("total_events"), F.min(at).alias("first_us"), F.max(at).alias("last_us"),
            F.max("ingest_seq").alias("last_seq"), F.min("shard_id").alias("shard_id"),
            # the value at the last or first position, nulls included, inside a partial aggregate
            F.max(F.when(det, F.struct(F.col("ingest_seq"), F.col("child_guid").alias("v")))).alias("last_det"),
            F.min(F.struct(F.col("ingest_seq"), F.col("parent_guid").alias("v"))).alias("first_ev"))
        chosen = F.col("last_det.v")
        root = F.when(chosen.isNotNull() & (chosen != ""), chosen).otherwise(F.col("first_ev.v"))
        hit = _TOTALS[trace] = materialize(a.withColumn("root_guid", root).drop("last_det", "first_ev"))
    return hit
