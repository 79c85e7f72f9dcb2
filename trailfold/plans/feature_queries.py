"""Registered summary and feature-domain queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailfold.operators import features, summary
from trailfold.plans import oracle as O
from trailfold.plans.catalog import register
from trailfold.plans.inputs import Inputs
from trailfold.schemas import FEATURES


def mx(x: str, floor: str = "1") -> str:
    return f"greatest(CAST({floor} AS DOUBLE), CAST({x} AS DOUBLE))"


def r9(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 9)"


@register("trace_summary", None)
def _trace_summary(i: Inputs):
    """UD-01: the nested summary struct per experiment (rows-only: nested output).

    Read from the session's summary store (built once from the landed trace,
    then reused by text rendering, retrieval demonstrations and scoring).
    """
    return summary.summary_store(i.trace).drop("rule_order", "text_repr")


def summary_text_parts() -> tuple[str, list[str]]:
    """(select, ctes) of the summary text in SQL — reused by the prompt oracles."""
    from trailfold.plans.trace_queries import TOP
    nl = "chr(10)"
    select = f"""
SELECT r.experiment AS experiment_id,
  '=== Dynamic Execution Trace Summary (Experiment: ' || r.experiment || ') ===' || {nl}
  || 'Execution Metrics: ' || CAST(r.total_events AS VARCHAR) || ' total events | Duration: '
  || CAST(r.duration_seconds AS VARCHAR) || 's | Avg Rate: ' || CAST(r.avg_events_per_sec AS VARCHAR)
  || ' ev/s | Peak Rate: ' || CAST(r.peak_events_per_sec AS VARCHAR) || ' ev/s' || {nl} || {nl}
  || '--- Event Counts by Rule ---' || rt.rules
  || {nl} || {nl} || '--- Entity Diversity Counts ---'
  || {nl} || '  - processes: ' || CAST(ent.processes AS VARCHAR)
  || {nl} || '  - unique_files_created: ' || CAST(ent.unique_files_created AS VARCHAR)
  || {nl} || '  - unique_images_loaded: ' || CAST(ent.unique_images_loaded AS VARCHAR)
  || {nl} || '  - unique_registry_keys: ' || CAST(ent.unique_registry_keys AS VARCHAR)
  || {nl} || '  - unique_network_connections: ' || CAST(ent.unique_network_connections AS VARCHAR)
  || {nl} || {nl} || '--- Process Tree Structure ---'
  || {nl} || '  - Total Processes Involved: ' || CAST(coalesce(procs.processes, 0) AS VARCHAR)
  || {nl} || '  - Max Process Tree Depth: ' || CAST(coalesce(depth.max_tree_depth, 1) AS VARCHAR)
  || {nl} || '  - Max Branching Factor: ' || CAST(tf.max_branching_factor AS VARCHAR)
  || {nl} || '  - Root Process Direct Children: ' || CAST(tf.root_spawned_children AS VARCHAR)
  || {nl} || {nl} || '--- Top Active Process Profiles ---' || coalesce(tp.procs, '')
  || {nl} || {nl} || '--- Chronological Event Flow (Run-Length Encoded) ---' || {nl} || '  ' || fl.flow
  AS text_repr
FROM rates r JOIN rt ON rt.experiment = r.experiment JOIN ent ON ent.experiment = r.experiment
JOIN tf ON tf.experiment = r.experiment LEFT JOIN depth ON depth.experiment = r.experiment
LEFT JOIN procs ON procs.experiment = r.experiment LEFT JOIN tp ON tp.experiment = r.experiment
JOIN fl ON fl.experiment = r.experiment"""
    ctes = [O.BOUNDS, O.ENTITIES, O.TREE, TOP, O.STARTS, f"""rt AS (
  SELECT experiment, string_agg({nl} || '  - ' || rule || ': ' || CAST(n AS VARCHAR), '' ORDER BY n DESC, fs) AS rules
  FROM (SELECT experiment, RuleName AS rule, count(*) AS n, min(ingest_seq) AS fs FROM trace
        GROUP BY experiment, RuleName) GROUP BY experiment),
tp AS (
  SELECT experiment, string_agg({nl} || '  * ' || process_id
           || CASE WHEN is_root THEN ' (Root Detonation Binary)' ELSE '' END
           || ': ' || CAST(total_actions AS VARCHAR) || ' actions, spawned ' || CAST(children_spawned AS VARCHAR)
           || ' child processes' || {nl} || '    Actions: ' || action_text, '' ORDER BY rank) AS procs
  FROM topp GROUP BY experiment),
fl AS (
  SELECT experiment,
         string_agg(CASE WHEN run_no <= 40 THEN
                      CASE WHEN run_len > 1 THEN rule || ' x' || CAST(run_len AS VARCHAR) ELSE rule END END,
                    ' -> ' ORDER BY run_no)
         || CASE WHEN count(*) > 40
                 THEN ' -> ... [' || CAST(count(*) - 40 AS VARCHAR) || ' further event runs omitted]'
                 ELSE '' END AS flow
  FROM runs GROUP BY experiment)"""]
    return select, ctes


def _summary_text_sql() -> str:
    select, ctes = summary_text_parts()
    return O.q(select, *ctes)


def summary_figures_sql(extra: str) -> str:
    """``experiment_id, shard_id`` and ``extra`` columns of the summary in SQL."""
    select, ctes = summary_text_parts()
    return O.q(f"""SELECT r.experiment AS experiment_id, sh.shard_id, {extra}
FROM rates r JOIN (SELECT experiment, min(shard_id) AS shard_id FROM trace GROUP BY experiment) sh ON sh.experiment = r.experiment
JOIN tx ON tx.experiment_id = r.experiment JOIN ent ON ent.experiment = r.experiment JOIN tf ON tf.experiment = r.experiment
LEFT JOIN depth ON depth.experiment = r.experiment LEFT JOIN fl ON fl.experiment = r.experiment
LEFT JOIN (SELECT experiment, count(*) AS n_top FROM topp GROUP BY experiment) tn ON tn.experiment = r.experiment""",
               *ctes, "tx AS (" + select.strip() + ")")


@register("trace_summary_flat", summary_figures_sql("""r.total_events, r.duration_seconds, r.avg_events_per_sec, r.peak_events_per_sec,
  ent.processes, ent.unique_files_created, ent.unique_images_loaded, ent.unique_registry_keys, ent.unique_network_connections,
  coalesce(depth.max_tree_depth, 1) AS max_tree_depth, tf.max_branching_factor, tf.root_spawned_children, fl.flow,
  coalesce(tn.n_top, 0) AS n_top, tx.text_repr"""))
def _trace_summary_flat(i: Inputs):
    """UD-01 flattened: figures, flow and text of the stored summary."""
    s = summary.summary_store(i.trace)
    return s.select("experiment_id", "shard_id", "total_events", "duration_seconds", "avg_events_per_sec", "peak_events_per_sec",
                    *[F.col(f"entity_counts.{c}").alias(c) for c in summary.ENTITY_FIELDS],
                    *[F.col(f"process_tree.{c}").alias(c) for c in summary.TREE_FIELDS if c != "total_processes"],
                    F.array_join("event_sequence_compressed", " -> ").alias("flow"),
                    F.size("top_processes").cast("long").alias("n_top"), "text_repr")


@register("summary_text", _summary_text_sql())
def _summary_text(i: Inputs):
    """PB-01: rendered summary text per experiment (from the summary store)."""
    return summary.summary_store(i.trace).select("experiment_id", "text_repr")


LEAVES = """pset AS (SELECT DISTINCT experiment, g FROM (
    SELECT experiment, parent_guid AS g FROM trace
    UNION SELECT experiment, child_guid AS g FROM trace WHERE RuleName = 'process_create') WHERE g IS NOT NULL),
lv AS (SELECT ps.experiment, count(*) AS leaves FROM pset ps
  WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.experiment = ps.experiment AND e.parent_guid = ps.g)
  GROUP BY ps.experiment),
pt AS (SELECT tf.experiment, CAST(coalesce(procs.processes, 0) AS BIGINT) AS P,
         coalesce(depth.max_tree_depth, 1) AS D, tf.max_branching_factor AS B, tf.root_spawned_children AS C
       FROM tf LEFT JOIN depth ON depth.experiment = tf.experiment
       LEFT JOIN procs ON procs.experiment = tf.experiment)"""

SQL_A = O.q(f"""
SELECT pt.experiment, D AS max_tree_depth, B AS max_branching_factor, P AS total_processes,
       C AS root_spawned_children,
       {r9('D / ' + mx('P'))} AS depth_to_process_ratio,
       {r9('B / ' + mx('P'))} AS branching_to_process_ratio,
       {r9('C / ' + mx('P - 1'))} AS root_fanout_share,
       CAST(P - 1 AS BIGINT) AS non_root_processes,
       {r9('P / ' + mx('rates.duration_seconds'))} AS process_density_per_sec,
       {r9('log2(D + 1) * log2(B + 1)')} AS process_chain_complexity,
       {r9('coalesce(lv.leaves, 0) / ' + mx('P'))} AS leaf_process_ratio,
       CAST(P = 1 AS INTEGER) AS is_single_process_execution
FROM pt JOIN rates ON rates.experiment = pt.experiment LEFT JOIN lv ON lv.experiment = pt.experiment""",
    O.TREE, O.PROCS, O.BOUNDS, LEAVES)

SQL_B = O.q(f"""
SELECT experiment, duration_seconds, avg_events_per_sec, peak_events_per_sec,
       {r9('peak_events_per_sec / ' + mx('avg_events_per_sec', '0.01'))} AS burst_ratio,
       {r9('ln(total_events + 1)')} AS log1p_total_events,
       {r9('ln(duration_seconds + 1)')} AS log1p_duration,
       {r9('(peak_events_per_sec - avg_events_per_sec) / ' + mx('duration_seconds'))} AS event_acceleration,
       CAST(duration_seconds < 1.0 AS INTEGER) AS is_subsecond_execution,
       CAST(duration_seconds >= 295.0 AS INTEGER) AS is_timeout_execution,
       {r9('total_events / ln(duration_seconds + 2)')} AS event_density
FROM rates""", O.BOUNDS)

SQL_C = O.q(f"""
SELECT ent.experiment, unique_files_created, unique_images_loaded, unique_registry_keys,
       unique_network_connections,
       {r9('unique_files_created / ' + mx('file_create'))} AS file_churn_ratio,
       {r9('unique_registry_keys / ' + mx('reg_create_key + reg_write'))} AS registry_churn_ratio,
       {r9('unique_images_loaded / ' + mx('image_load'))} AS image_churn_ratio,
       {r9('unique_network_connections / ' + mx('net_connect'))} AS network_fanout_ratio,
       CAST(unique_files_created + unique_images_loaded + unique_registry_keys + unique_network_connections
            + processes AS BIGINT) AS total_unique_entities,
       {r9('(unique_files_created + unique_images_loaded + unique_registry_keys + unique_network_connections'
           ' + processes) / ' + mx('m.M'))} AS entity_diversity_score,
       {r9('unique_files_created / ' + mx('processes'))} AS file_per_process,
       {r9('unique_registry_keys / ' + mx('processes'))} AS reg_per_process
FROM ent JOIN fc ON fc.experiment = ent.experiment
JOIN (SELECT experiment, count(*) AS M FROM trace GROUP BY experiment) m ON m.experiment = ent.experiment""",
    O.ENTITIES, O.FEATURE_COUNTS)

SQL_D = O.q(f"""
SELECT ra.experiment, root_total_actions,
       {r9('root_total_actions / ' + mx('M'))} AS root_action_share,
       root_process_creates, root_file_creates, root_reg_writes, root_net_connects,
       CAST(root_total_actions = M AS INTEGER) AS is_root_sole_actor,
       {r9('coalesce(top.top_actions, 0) / ' + mx('M'))} AS top_process_dominance,
       {r9('root_total_actions / ' + mx('coalesce(top.top_actions, 0)'))} AS root_to_top_process_ratio,
       {r9('1.0 - root_total_actions / ' + mx('M'))} AS worker_delegation_index
FROM ra LEFT JOIN top ON top.experiment = ra.experiment""", O.ROOT, """ra AS (
  SELECT t.experiment, count(*) AS M,
         count_if(t.parent_guid = root.root_guid) AS root_total_actions,
         count_if(t.parent_guid = root.root_guid AND RuleName = 'process_create') AS root_process_creates,
         count_if(t.parent_guid = root.root_guid AND RuleName = 'file_create') AS root_file_creates,
         count_if(t.parent_guid = root.root_guid AND RuleName = 'reg_write') AS root_reg_writes,
         count_if(t.parent_guid = root.root_guid AND RuleName = 'net_connect') AS root_net_connects
  FROM trace t JOIN root ON root.experiment = t.experiment GROUP BY t.experiment),
top AS (SELECT experiment, max(n) AS top_actions FROM (
  SELECT experiment, parent_guid, count(*) AS n FROM trace WHERE parent_guid IS NOT NULL
  GROUP BY experiment, parent_guid) GROUP BY experiment)""")

SQL_E = O.q(f"""
SELECT fc.experiment,
       {r9('process_term / ' + mx('process_create'))} AS process_term_ratio,
       {r9('net_connect / ' + mx('file_create'))} AS dropper_ratio,
       {r9('process_create / ' + mx('file_create'))} AS execution_ratio,
       {r9('(reg_delete_key + reg_delete_value) / ' + mx('reg_write + reg_create_key'))} AS tampering_ratio,
       {r9('(reg_write + reg_create_key) / ' + mx('m.M'))} AS persistence_intensity,
       {r9('net_connect / ' + mx('m.M'))} AS network_intensity,
       {r9('file_create / ' + mx('m.M'))} AS file_intensity,
       {r9('image_load / ' + mx('m.M'))} AS image_intensity,
       CAST(net_connect > 0 AS INTEGER) AS has_network_activity,
       CAST(reg_delete_key + reg_delete_value > 0 AS INTEGER) AS has_registry_tampering,
       CAST(depth.max_tree_depth >= 3 AS INTEGER) AS has_deep_process_chain
FROM fc JOIN (SELECT experiment, count(*) AS M FROM trace GROUP BY experiment) m ON m.experiment = fc.experiment
JOIN depth ON depth.experiment = fc.experiment""", O.FEATURE_COUNTS, O.TREE)

_named = ",\n       ".join(f"count_if(a = '{x}' AND b = '{y}') AS {n}" for n, x, y in features.TRANSITIONS)
SQL_F = O.q(f"""
SELECT e.experiment, {', '.join(f'coalesce(nb.{n}, 0) AS {n}' for n, _, _ in features.TRANSITIONS)},
       coalesce(nb.trans_reg_to_reg, 0) AS trans_reg_to_reg,
       coalesce(st.unique_transition_types, 0) AS unique_transition_types,
       coalesce(st.transition_entropy, 0.0) AS transition_entropy
FROM (SELECT DISTINCT experiment FROM trace) e
LEFT JOIN nb ON nb.experiment = e.experiment LEFT JOIN st ON st.experiment = e.experiment""", O.BIGRAMS, f"""nb AS (
  SELECT experiment, {_named},
       count_if(starts_with(a, 'reg_') AND starts_with(b, 'reg_')) AS trans_reg_to_reg
  FROM bg GROUP BY experiment),
st AS (SELECT experiment, count(*) AS unique_transition_types,
         round(-sum((n / tot) * log2(n / tot)), 6) AS transition_entropy
       FROM (SELECT *, sum(n) OVER (PARTITION BY experiment) AS tot FROM bgc) GROUP BY experiment)""")

for _dom, _sql in zip("ABCDEF", (SQL_A, SQL_B, SQL_C, SQL_D, SQL_E, SQL_F)):
    def _mk(d=_dom):
        def f(i: Inputs):
            return features.DOMAINS[d](i.trace)
        f.__doc__ = f"Feature domain {d}."
        return f
    register(f"features_{_dom}", _sql)(_mk())


def _features_all_sql() -> str:
    """The domains' own SQL side by side; a column that several have is taken from the first."""
    taken = ["experiment", *FEATURES, "total_events"]
    parts, joins = [f"fc.{c}" for c in FEATURES], ""
    for dom, sql in zip("ABCDEF", (SQL_A, SQL_B, SQL_C, SQL_D, SQL_E, SQL_F)):
        new = [c for c in features.DOMAIN_COLUMNS[dom] if c not in taken]
        taken += new
        parts += [f"d{dom}.{c}" for c in new]
        joins += f" JOIN ({sql}) d{dom} ON d{dom}.experiment = fc.experiment"
    return O.q(f"""SELECT fc.experiment, {', '.join(parts)}, m.total_events
FROM fc JOIN (SELECT experiment, count(*) AS total_events FROM trace GROUP BY experiment) m ON m.experiment = fc.experiment{joins}""",
               O.FEATURE_COUNTS)


@register("features_all", _features_all_sql())
def _features_all(i: Inputs):
    """All 65 derived features + 9 counts + total events, one row per experiment."""
    return features.all_features(i.trace)
