"""The derived feature catalogue (65 features in six domains, A–F).

Each domain is one function returning ``experiment`` + its feature columns,
built from the per-experiment operator outputs (one row per experiment,
joined on ``experiment``).  Ratios are rounded to 9 digits so results are
stable across engines; flags are 0/1 integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailfold.operators import counts, entities, processes, rates, sequence, tree
from trailfold.operators.entities import process_set
from trailfold.operators.folds import by_experiment, by_process

R = 9


def _r(c: Column) -> Column:
    return F.round(c.cast("double"), R)


def _mx(c: Column, floor: float = 1.0) -> Column:
    return F.greatest(F.lit(floor), c.cast("double"))


def _flag(c: Column) -> Column:
    return c.cast("int")


def leaf_counts(trace: DataFrame) -> DataFrame:
    """#11 input: processes that spawn no child (exact, by anti-join on edge parents)."""
    ps = process_set(trace)
    parents = tree.tree_edges(trace).select("experiment", F.col("parent_guid").alias("guid")).distinct()
    return (ps.join(parents, ["experiment", "guid"], "left_anti")
            .groupBy("experiment").agg(F.count(F.lit(1)).alias("leaves")))


def domain_a(trace: DataFrame) -> DataFrame:
    pt = tree.process_tree(trace)
    rt = rates.trace_rates(trace).select("experiment", "duration_seconds")
    lv = leaf_counts(trace)
    j = pt.join(rt, "experiment").join(lv, "experiment", "left")
    D, B, P, C = (F.col(c) for c in ("max_tree_depth", "max_branching_factor", "total_processes",
                                     "root_spawned_children"))
    T = F.col("duration_seconds")
    return j.select(
        "experiment", D.alias("max_tree_depth"), B.alias("max_branching_factor"), P.alias("total_processes"),
        C.alias("root_spawned_children"),
        _r(D / _mx(P)).alias("depth_to_process_ratio"),
        _r(B / _mx(P)).alias("branching_to_process_ratio"),
        _r(C / _mx(P - 1)).alias("root_fanout_share"),
        (P - 1).cast("long").alias("non_root_processes"),
        _r(P / _mx(T)).alias("process_density_per_sec"),
        _r(F.log2(D + 1) * F.log2(B + 1)).alias("process_chain_complexity"),
        _r(F.coalesce(F.col("leaves"), F.lit(0)) / _mx(P)).alias("leaf_process_ratio"),
        _flag(P == 1).alias("is_single_process_execution"),
    )


def domain_b(trace: DataFrame) -> DataFrame:
    rt = rates.trace_rates(trace)
    M, T = F.col("total_events"), F.col("duration_seconds")
    avg, peak = F.col("avg_events_per_sec"), F.col("peak_events_per_sec")
    return rt.select(
        "experiment", T.alias("duration_seconds"), avg.alias("avg_events_per_sec"),
        peak.alias("peak_events_per_sec"),
        _r(peak / _mx(avg, 0.01)).alias("burst_ratio"),
        _r(F.log1p(M)).alias("log1p_total_events"),
        _r(F.log1p(T)).alias("log1p_duration"),
        _r((peak - avg) / _mx(T)).alias("event_acceleration"),
        _flag(T < 1.0).alias("is_subsecond_execution"),
        _flag(T >= 295.0).alias("is_timeout_execution"),
        _r(M / F.log(T + 2)).alias("event_density"),
    )


def domain_c(trace: DataFrame) -> DataFrame:
    ent = entities.entity_counts(trace)
    fc = counts.feature_counts(trace)
    m = by_experiment(trace).select("experiment", F.col("total_events").alias("M"))
    j = ent.join(fc, "experiment").join(m, "experiment")
    uf, ui, ur, un, P = (F.col(c) for c in ("unique_files_created", "unique_images_loaded",
                                            "unique_registry_keys", "unique_network_connections", "processes"))
    tot = uf + ui + ur + un + P
    return j.select(
        "experiment", uf.alias("unique_files_created"), ui.alias("unique_images_loaded"),
        ur.alias("unique_registry_keys"), un.alias("unique_network_connections"),
        _r(uf / _mx(F.col("file_create"))).alias("file_churn_ratio"),
        _r(ur / _mx(F.col("reg_create_key") + F.col("reg_write"))).alias("registry_churn_ratio"),
        _r(ui / _mx(F.col("image_load"))).alias("image_churn_ratio"),
        _r(un / _mx(F.col("net_connect"))).alias("network_fanout_ratio"),
        tot.cast("long").alias("total_unique_entities"),
        _r(tot / _mx(F.col("M"))).alias("entity_diversity_score"),
        _r(uf / _mx(P)).alias("file_per_process"),
        _r(ur / _mx(P)).alias("reg_per_process"),
    )


def root_actions(trace: DataFrame) -> DataFrame:
    """#35–40 inputs: events whose parent is the root, in total and for four rules."""
    roots = tree.root_process(trace)
    t = by_process(trace).join(roots, "experiment")          # counts per process and rule, not events
    on_root = F.col("parent_guid") == F.col("root_guid")
    rule = F.col("rule")

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(0))
    return t.groupBy("experiment").agg(
        F.sum("n").alias("M"),
        total(on_root).alias("root_total_actions"),
        total(on_root & (rule == "process_create")).alias("root_process_creates"),
        total(on_root & (rule == "file_create")).alias("root_file_creates"),
        total(on_root & (rule == "reg_write")).alias("root_reg_writes"),
        total(on_root & (rule == "net_connect")).alias("root_net_connects"))


def domain_d(trace: DataFrame) -> DataFrame:
    ra = root_actions(trace)
    top = (processes.process_activity(trace).groupBy("experiment")
           .agg(F.max("total_actions").alias("top_actions")))
    j = ra.join(top, "experiment", "left")
    A, M = F.col("root_total_actions"), F.col("M")
    top_a = F.coalesce(F.col("top_actions"), F.lit(0))
    return j.select(
        "experiment", A.alias("root_total_actions"),
        _r(A / _mx(M)).alias("root_action_share"),
        "root_process_creates", "root_file_creates", "root_reg_writes", "root_net_connects",
        _flag(A == M).alias("is_root_sole_actor"),
        _r(top_a / _mx(M)).alias("top_process_dominance"),
        _r(A / _mx(top_a)).alias("root_to_top_process_ratio"),
        _r(1.0 - A / _mx(M)).alias("worker_delegation_index"),
    )


def domain_e(trace: DataFrame) -> DataFrame:
    fc = counts.feature_counts(trace)
    m = by_experiment(trace).select("experiment", F.col("total_events").alias("M"))
    d = tree.tree_depth(trace)
    j = fc.join(m, "experiment").join(d, "experiment")
    c = F.col
    reg_mod = c("reg_write") + c("reg_create_key")
    reg_del = c("reg_delete_key") + c("reg_delete_value")
    return j.select(
        "experiment",
        _r(c("process_term") / _mx(c("process_create"))).alias("process_term_ratio"),
        _r(c("net_connect") / _mx(c("file_create"))).alias("dropper_ratio"),
        _r(c("process_create") / _mx(c("file_create"))).alias("execution_ratio"),
        _r(reg_del / _mx(reg_mod)).alias("tampering_ratio"),
        _r(reg_mod / _mx(c("M"))).alias("persistence_intensity"),
        _r(c("net_connect") / _mx(c("M"))).alias("network_intensity"),
        _r(c("file_create") / _mx(c("M"))).alias("file_intensity"),
        _r(c("image_load") / _mx(c("M"))).alias("image_intensity"),
        _flag(c("net_connect") > 0).alias("has_network_activity"),
        _flag(reg_del > 0).alias("has_registry_tampering"),
        _flag(c("max_tree_depth") >= 3).alias("has_deep_process_chain"),
    )


# --- fixed values: the named transitions of domain F ---
TRANSITIONS = [
    ("trans_net_to_file", "net_connect", "file_create"),
    ("trans_file_to_proc", "file_create", "process_create"),
    ("trans_proc_to_img", "process_create", "image_load"),
    ("trans_img_to_reg", "image_load", "reg_write"),
    ("trans_reg_to_del", "reg_create_key", "reg_delete_key"),
    ("trans_proc_to_term", "process_create", "process_term"),
    ("trans_file_to_file", "file_create", "file_create"),
]
# --- end fixed values ---


def domain_f(trace: DataFrame) -> DataFrame:
    """Bigram features on the raw (not run-length) sequence."""
    bg = sequence.bigram_rows(trace)
    a, b = F.col("a"), F.col("b")
    named = bg.groupBy("experiment").agg(
        *[F.count_if((a == x) & (b == y)).alias(n) for n, x, y in TRANSITIONS],
        F.count_if(a.startswith("reg_") & b.startswith("reg_")).alias("trans_reg_to_reg"))
    st = sequence.transition_stats(trace)
    base = by_experiment(trace).select("experiment")
    j = base.join(named, "experiment", "left").join(st, "experiment", "left")
    cols = [n for n, _, _ in TRANSITIONS] + ["trans_reg_to_reg"]
    return j.select(
        "experiment", *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in cols],
        F.coalesce("unique_transition_types", F.lit(0)).cast("long").alias("unique_transition_types"),
        F.coalesce("transition_entropy", F.lit(0.0)).alias("transition_entropy"),
    )


DOMAIN_COLUMNS = {
    "A": ["max_tree_depth", "max_branching_factor", "total_processes", "root_spawned_children",
          "depth_to_process_ratio", "branching_to_process_ratio", "root_fanout_share", "non_root_processes",
          "process_density_per_sec", "process_chain_complexity", "leaf_process_ratio",
          "is_single_process_execution"],
    "B": ["duration_seconds", "avg_events_per_sec", "peak_events_per_sec", "burst_ratio", "log1p_total_events",
          "log1p_duration", "event_acceleration", "is_subsecond_execution", "is_timeout_execution",
          "event_density"],
    "C": ["unique_files_created", "unique_images_loaded", "unique_registry_keys", "unique_network_connections",
          "file_churn_ratio", "registry_churn_ratio", "image_churn_ratio", "network_fanout_ratio",
          "total_unique_entities", "entity_diversity_score", "file_per_process", "reg_per_process"],
    "D": ["root_total_actions", "root_action_share", "root_process_creates", "root_file_creates",
          "root_reg_writes", "root_net_connects", "is_root_sole_actor", "top_process_dominance",
          "root_to_top_process_ratio", "worker_delegation_index"],
    "E": ["process_term_ratio", "dropper_ratio", "execution_ratio", "tampering_ratio", "persistence_intensity",
          "network_intensity", "file_intensity", "image_intensity", "has_network_activity",
          "has_registry_tampering", "has_deep_process_chain"],
    "F": [n for n, _, _ in TRANSITIONS] + ["trans_reg_to_reg", "unique_transition_types", "transition_entropy"],
}

DOMAINS = {"A": domain_a, "B": domain_b, "C": domain_c, "D": domain_d, "E": domain_e, "F": domain_f}


def all_features(trace: DataFrame) -> DataFrame:
    """All six domains joined (65 features + the 9 counts + total_events)."""
    fc = counts.feature_counts(trace)
    m = by_experiment(trace).select("experiment", "total_events")
    out = fc.join(m, "experiment")
    for fn in DOMAINS.values():
        d = fn(trace)
        keep = [c for c in d.columns if c == "experiment" or c not in out.columns]
        out = out.join(d.select(*keep), "experiment")
    return out
