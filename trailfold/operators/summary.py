"""The bounded per-experiment behaviour summary (UD-01) and its text form (PB-01).

Not one UDF: each part is its own aggregate/window stage (counts, rates,
entities, tree, run-length flow, top processes); the parts are one row per
experiment and are joined on ``experiment``.  Parts that are already
hash-partitioned on ``experiment`` join without a further shuffle.
"""

from __future__ import annotations

import weakref

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailfold.operators import counts, entities, processes, rates, sequence, tree
from trailfold.operators.folds import by_experiment
from trailfold.session import materialize

ENTITY_FIELDS = ["processes", "unique_files_created", "unique_images_loaded", "unique_registry_keys",
                 "unique_network_connections"]
TREE_FIELDS = ["total_processes", "max_tree_depth", "max_branching_factor", "root_spawned_children"]


def trace_summary(trace: DataFrame) -> DataFrame:
    """``experiment_id, shard_id, total_events, duration_seconds, avg_events_per_sec,
    peak_events_per_sec, rule_counts, entity_counts, process_tree,
    event_sequence_compressed, top_processes, rule_order``.

    ``rule_order`` (array of ``rule`` by count desc, first-seen on ties) is kept
    for the text rendering; ``rule_counts`` is insertion-ordered by first
    appearance, as a Python ``Counter`` is.
    """
    r = rates.trace_rates(trace)
    ranked = counts.rule_counts_ranked(trace)
    rc = ranked.groupBy("experiment").agg(
        F.array_sort(F.collect_list(F.struct("first_seq", "rule", "n"))).alias("by_first"),
        F.array_sort(F.collect_list(F.struct("rank", "rule", "n"))).alias("by_rank"))
    ent = entities.entity_counts(trace)
    pt = tree.process_tree(trace)
    flow = sequence.rle_display(trace)
    top = processes.top_processes(trace)
    by_rank = lambda x, y: F.when(x["rank"] < y["rank"], -1).when(x["rank"] > y["rank"], 1).otherwise(0)
    tp = top.groupBy("experiment").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "process_id", "is_root", "total_actions", "children_spawned", "action_breakdown")), by_rank)
        .alias("tp"))
    shard = by_experiment(trace).select("experiment", "shard_id")
    j = (r.join(rc, "experiment").join(ent, "experiment").join(pt, "experiment")
         .join(flow, "experiment").join(shard, "experiment").join(tp, "experiment", "left"))
    return j.select(
        F.col("experiment").alias("experiment_id"),
        "shard_id", "total_events", "duration_seconds", "avg_events_per_sec", "peak_events_per_sec",
        F.map_from_arrays(F.transform("by_first", lambda s: s["rule"]),
                          F.transform("by_first", lambda s: s["n"])).alias("rule_counts"),
        F.struct(*ENTITY_FIELDS).alias("entity_counts"),
        F.struct(*TREE_FIELDS).alias("process_tree"),
        F.col("runs").alias("event_sequence_compressed"),
        F.coalesce(F.transform("tp", lambda s: s.dropFields("rank")),
                   F.array().cast("array<struct<process_id:string,is_root:boolean,total_actions:bigint,"
                                  "children_spawned:bigint,action_breakdown:map<string,bigint>>>"))
        .alias("top_processes"),
        F.transform("by_rank", lambda s: F.struct(s["rule"].alias("rule"), s["n"].alias("n"))).alias("rule_order"),
    )


def _num(c: Column) -> Column:
    return c.cast("string")


def summary_text(summary: DataFrame) -> DataFrame:
    """PB-01: ``experiment_id, text_repr`` — the fixed human-readable layout."""
    return summary.select("experiment_id", text_column().alias("text_repr"))


def with_text(summary: DataFrame) -> DataFrame:
    """The summary plus its ``text_repr`` column (one pass, no self-join)."""
    return summary.withColumn("text_repr", text_column())


def text_column() -> Column:
    """PB-01 as a column expression over the summary columns."""
    ent = F.col("entity_counts")
    pt = F.col("process_tree")
    header = F.concat(
        F.lit("=== Dynamic Execution Trace Summary (Experiment: "), F.col("experiment_id"), F.lit(") ===\n"),
        F.lit("Execution Metrics: "), _num(F.col("total_events")), F.lit(" total events | Duration: "),
        _num(F.col("duration_seconds")), F.lit("s | Avg Rate: "), _num(F.col("avg_events_per_sec")),
        F.lit(" ev/s | Peak Rate: "), _num(F.col("peak_events_per_sec")), F.lit(" ev/s\n\n"),
        F.lit("--- Event Counts by Rule ---"))
    rules = F.array_join(F.transform("rule_order", lambda x: F.concat(F.lit("\n  - "), x["rule"], F.lit(": "),
                                                                       _num(x["n"]))), "")
    ents = F.concat(F.lit("\n\n--- Entity Diversity Counts ---"),
                    *[F.concat(F.lit(f"\n  - {f}: "), _num(ent[f])) for f in ENTITY_FIELDS])
    tree_txt = F.concat(
        F.lit("\n\n--- Process Tree Structure ---"),
        F.lit("\n  - Total Processes Involved: "), _num(pt["total_processes"]),
        F.lit("\n  - Max Process Tree Depth: "), _num(pt["max_tree_depth"]),
        F.lit("\n  - Max Branching Factor: "), _num(pt["max_branching_factor"]),
        F.lit("\n  - Root Process Direct Children: "), _num(pt["root_spawned_children"]))
    procs = F.array_join(F.transform("top_processes", lambda p: F.concat(
        F.lit("\n  * "), p["process_id"], F.when(p["is_root"], F.lit(" (Root Detonation Binary)")).otherwise(""),
        F.lit(": "), _num(p["total_actions"]), F.lit(" actions, spawned "), _num(p["children_spawned"]),
        F.lit(" child processes\n    Actions: "),
        F.array_join(F.transform(F.map_entries(p["action_breakdown"]),
                                 lambda e: F.concat(e["key"], F.lit(": "), _num(e["value"]))), ", "))), "")
    flow = F.concat(F.lit("\n\n--- Chronological Event Flow (Run-Length Encoded) ---\n  "),
                    F.array_join("event_sequence_compressed", " -> "))
    return F.concat(header, rules, ents, tree_txt, F.lit("\n\n--- Top Active Process Profiles ---"), procs, flow)


def summary_record(summary: DataFrame) -> DataFrame:
    """The stored form (SNK-05/06): ``experiment_id, shard_id, total_events,
    duration_seconds, json_data, text_repr``."""
    data = F.to_json(F.struct(
        "experiment_id", "total_events", "duration_seconds", "avg_events_per_sec", "peak_events_per_sec",
        "rule_counts", "entity_counts", "process_tree", "event_sequence_compressed", "top_processes"))
    return summary.select("experiment_id", "shard_id", "total_events", "duration_seconds",
                          data.alias("json_data"), text_column().alias("text_repr"))


_STORES: "weakref.WeakKeyDictionary[DataFrame, DataFrame]" = weakref.WeakKeyDictionary()


def summary_store(trace: DataFrame) -> DataFrame:
    """The summary table with text, materialised once per trace (reliable checkpoint).

    This is the store the scoring and retrieval steps read (the reference
    keeps it as a table too); memoised per landed trace DataFrame.
    """
    hit = _STORES.get(trace)
    if hit is None:
        hit = materialize(with_text(trace_summary(trace)))
        _STORES[trace] = hit
    return hit
