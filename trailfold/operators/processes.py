"""Per-process activity, top-5 profiles and anonymised tags (AG-10/11, WN-05, PRJ-09)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailfold.operators.folds import by_process
from trailfold.operators.tree import fanout, root_process

TOP_K = 5


def process_activity(trace: DataFrame) -> DataFrame:
    """AG-10: ``experiment, parent_guid, total_actions, first_seq`` for non-null parents."""
    return (by_process(trace).where(F.col("parent_guid").isNotNull())
            .groupBy("experiment", "parent_guid")
            .agg(F.sum("n").alias("total_actions"), F.min("first_seq").alias("first_seq")))


def process_breakdown(trace: DataFrame) -> DataFrame:
    """AG-11: ``experiment, parent_guid, rule, n, first_seq`` — actions per process and rule."""
    return (by_process(trace).where(F.col("parent_guid").isNotNull())
            .select("experiment", "parent_guid", "rule", "n", "first_seq"))


def top_processes(trace: DataFrame, k: int = TOP_K) -> DataFrame:
    """WN-05 + PRJ-09: the k most active processes per experiment.

    Ties keep first-appearance order.  Output: ``experiment, rank,
    process_id, is_root, total_actions, children_spawned, action_text``
    plus ``action_breakdown`` (map, insertion order = first appearance).
    The ``row_number() <= k`` filter is planned as a window group limit, so
    each task keeps only k candidates per experiment before the shuffle.
    """
    act = process_activity(trace)
    w = Window.partitionBy("experiment").orderBy(F.desc("total_actions"), F.asc("first_seq"))
    top = act.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    roots = root_process(trace)
    fo = fanout(trace).withColumnRenamed("children", "children_spawned")
    bd = process_breakdown(trace).join(top.select("experiment", "parent_guid"), ["experiment", "parent_guid"],
                                       "left_semi")
    bd = bd.groupBy("experiment", "parent_guid").agg(
        F.array_sort(F.collect_list(F.struct("first_seq", "rule", "n"))).alias("bd"))
    out = (top.join(roots, "experiment", "left")
           .join(fo, ["experiment", "parent_guid"], "left")
           .join(bd, ["experiment", "parent_guid"], "left"))
    is_root = F.coalesce(F.col("parent_guid") == F.col("root_guid"), F.lit(False))
    return out.select(
        "experiment", F.col("rank").cast("long").alias("rank"),
        F.when(is_root, F.lit("Process_Root")).otherwise(F.concat(F.lit("Process_"), F.col("rank")))
         .alias("process_id"),
        is_root.alias("is_root"),
        F.col("total_actions").cast("long").alias("total_actions"),
        F.coalesce("children_spawned", F.lit(0)).cast("long").alias("children_spawned"),
        F.map_from_arrays(F.transform("bd", lambda s: s["rule"]),
                          F.transform("bd", lambda s: s["n"])).alias("action_breakdown"),
        F.array_join(F.transform("bd", lambda s: F.concat(s["rule"], F.lit(": "), s["n"].cast("string"))),
                     ", ").alias("action_text"),
    )
