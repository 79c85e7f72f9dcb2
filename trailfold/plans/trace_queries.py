"""Registered per-experiment trace queries (counts, rates, entities, tree, sequences)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailfold.operators import counts, entities, longest_path, processes, rates, sequence, tree
from trailfold.plans import oracle as O
from trailfold.plans.catalog import register
from trailfold.plans.inputs import Inputs


@register("rule_map", None)
def _rule_map(i: Inputs):
    """AG-03 (map output; rows-only)."""
    return counts.rule_map(i.trace)


@register("rule_map_text", O.q("""
SELECT experiment, string_agg(RuleName || '=' || CAST(n AS VARCHAR), ',' ORDER BY RuleName) AS rules
FROM (SELECT experiment, RuleName, count(*) AS n FROM trace GROUP BY experiment, RuleName) GROUP BY experiment"""))
def _rule_map_text(i: Inputs):
    """AG-03 as text: the map's entries in the order of their keys."""
    m = counts.rule_map(i.trace)
    name = next(c for c, t in m.dtypes if t.startswith("map"))
    return m.select("experiment", F.array_join(F.transform(F.array_sort(F.map_entries(name)), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("rules"))


@register("rule_counts_ranked", O.q("""
SELECT experiment, rule, n, first_seq,
       row_number() OVER (PARTITION BY experiment ORDER BY n DESC, first_seq) AS rank
FROM (SELECT experiment, RuleName AS rule, count(*) AS n, min(ingest_seq) AS first_seq
      FROM trace GROUP BY experiment, RuleName)"""))
def _rule_counts_ranked(i: Inputs):
    return counts.rule_counts_ranked(i.trace).select(
        "experiment", "rule", "n", "first_seq", F.col("rank").cast("long").alias("rank"))


@register("trace_scan", O.q("""
SELECT experiment, "timestamp", RuleName, parent_guid, child_guid, parent_name, child_name, shard_id, ingest_seq
FROM trace"""))
def _trace_scan(i: Inputs):
    """SRC-02 as seen through the lens: the full event table with shard and order key."""
    from trailfold.schemas import EVENTS
    return i.trace.select(*[f.name for f in EVENTS.fields])


@register("shard_profile", O.q("""
SELECT shard_id, count(*) AS events, count(DISTINCT experiment) AS experiments,
       count(DISTINCT (parent_guid, experiment)) FILTER (WHERE parent_guid IS NOT NULL) AS distinct_parents,
       count(DISTINCT (child_guid, experiment)) FILTER (WHERE child_guid IS NOT NULL) AS distinct_children,
       count(DISTINCT parent_name) AS distinct_parent_names, count(DISTINCT child_name) AS distinct_child_names,
       min("timestamp") AS first_ts, max("timestamp") AS last_ts
FROM trace GROUP BY shard_id"""))
def _shard_profile(i: Inputs):
    return counts.shard_profile(i.trace)


@register("experiment_profile", O.q("""
SELECT shard_id, experiment, count(*) AS events, count(DISTINCT RuleName) AS rules,
       count(DISTINCT parent_guid) AS parents, count(DISTINCT child_guid) AS children,
       count(DISTINCT child_name) AS child_names, min("timestamp") AS first_ts, max("timestamp") AS last_ts
FROM trace GROUP BY shard_id, experiment"""))
def _experiment_profile(i: Inputs):
    """AG-24 per experiment."""
    return counts.experiment_profile(i.trace)


@register("shard_span_check", O.q("""
SELECT 'shard_span' AS "check", count_if(shards > 1) AS n_violations
FROM (SELECT experiment, count(DISTINCT shard_id) AS shards FROM trace GROUP BY experiment)"""))
def _shard_span(i: Inputs):
    return counts.shard_span_check(i.trace)


@register("trace_duration", O.q("""
SELECT experiment, count(*) AS total_events, min(t_us) AS first_us, max(t_us) AS last_us,
       greatest(0.0, (max(t_us) - min(t_us)) / 1e6) AS duration_seconds
FROM trace GROUP BY experiment"""))
def _trace_duration(i: Inputs):
    return rates.trace_bounds(i.trace)


@register("trace_rates", O.q("SELECT * FROM rates", O.BOUNDS))
def _trace_rates(i: Inputs):
    return rates.trace_rates(i.trace)


@register("relative_offsets", O.q("""
SELECT t.experiment, t.ingest_seq, t.RuleName, t.parent_guid, t.child_guid, t.child_name,
       t.t_us - f.f AS offset_us
FROM trace t JOIN (SELECT experiment, min(t_us) AS f FROM trace GROUP BY experiment) f
  ON f.experiment = t.experiment"""))
def _relative_offsets(i: Inputs):
    return rates.relative_offsets(i.trace)


@register("peak_sliding", O.q("""
SELECT experiment, CAST(max(c) AS BIGINT) AS peak_sliding FROM (
  SELECT experiment, count(*) OVER (PARTITION BY experiment ORDER BY t_us
                                    RANGE BETWEEN 999999 PRECEDING AND CURRENT ROW) AS c
  FROM trace) GROUP BY experiment"""))
def _peak_sliding(i: Inputs):
    return rates.sliding_peak(i.trace)


@register("entity_counts", O.q("SELECT * FROM ent", O.ENTITIES))
def _entity_counts(i: Inputs):
    return entities.entity_counts(i.trace)


@register("tree_edges", O.q("SELECT * FROM edges", O.EDGES))
def _tree_edges(i: Inputs):
    return tree.tree_edges(i.trace)


@register("root_process", O.q("SELECT * FROM root", O.ROOT))
def _root_process(i: Inputs):
    return tree.root_process(i.trace)


@register("tree_fanout", O.q("SELECT * FROM tf", O.TREE))
def _tree_fanout(i: Inputs):
    return tree.tree_fanout(i.trace)


@register("tree_depth", O.q("SELECT * FROM depth", O.TREE))
def _tree_depth(i: Inputs):
    return tree.tree_depth(i.trace)


@register("tree_depth_dfs", O.q("""
SELECT experiment, CAST(max(len(path)) AS BIGINT) AS max_tree_depth FROM paths GROUP BY experiment""",
    O.TREE, """paths(experiment, node, path) AS (
  SELECT experiment, root_guid, [root_guid] FROM root
  UNION ALL
  SELECT p.experiment, de.child, list_append(p.path, de.child)
  FROM paths p JOIN de ON p.experiment = de.experiment AND p.node = de.node
  WHERE NOT list_contains(p.path, de.child))"""))
def _tree_depth_dfs(i: Inputs):
    return tree.tree_depth_dfs(i.trace)


@register("rule_chain", O.q("""
SELECT experiment, CAST(max(len(passed)) AS BIGINT) AS longest_chain FROM states GROUP BY experiment""",
    O.BIGRAMS, """states(experiment, node, passed) AS (
  SELECT experiment, RuleName, [RuleName] FROM trace WHERE ingest_seq = 1
  UNION
  SELECT s.experiment, g.b, list_sort(list_append(s.passed, g.b))
  FROM states s JOIN bgc g ON s.experiment = g.experiment AND s.node = g.a
  WHERE NOT list_contains(s.passed, g.b))"""))
def _rule_chain(i: Inputs):
    return longest_path.rule_chain(i.trace)


@register("process_tree", O.q("""
SELECT tf.experiment, CAST(coalesce(procs.processes, 0) AS BIGINT) AS total_processes,
       coalesce(depth.max_tree_depth, 1) AS max_tree_depth, tf.max_branching_factor, tf.root_spawned_children
FROM tf LEFT JOIN depth ON depth.experiment = tf.experiment LEFT JOIN procs ON procs.experiment = tf.experiment""",
    O.TREE, O.PROCS))
def _process_tree(i: Inputs):
    return tree.process_tree(i.trace)


@register("process_activity", O.q("""
SELECT experiment, parent_guid, count(*) AS total_actions, min(ingest_seq) AS first_seq
FROM trace WHERE parent_guid IS NOT NULL GROUP BY experiment, parent_guid"""))
def _process_activity(i: Inputs):
    return processes.process_activity(i.trace)


@register("process_breakdown", O.q("""
SELECT experiment, parent_guid, RuleName AS rule, count(*) AS n, min(ingest_seq) AS first_seq
FROM trace WHERE parent_guid IS NOT NULL GROUP BY experiment, parent_guid, RuleName"""))
def _process_breakdown(i: Inputs):
    return processes.process_breakdown(i.trace)


TOP = """act AS (SELECT experiment, parent_guid, count(*) AS total_actions, min(ingest_seq) AS first_seq
  FROM trace WHERE parent_guid IS NOT NULL GROUP BY experiment, parent_guid),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY experiment
          ORDER BY total_actions DESC, first_seq) AS rank FROM act) WHERE rank <= 5),
bd AS (SELECT experiment, parent_guid,
         string_agg(rule || ': ' || CAST(n AS VARCHAR), ', ' ORDER BY first_seq) AS action_text
       FROM (SELECT experiment, parent_guid, RuleName AS rule, count(*) AS n, min(ingest_seq) AS first_seq
             FROM trace WHERE parent_guid IS NOT NULL GROUP BY experiment, parent_guid, RuleName)
       GROUP BY experiment, parent_guid),
topp AS (
  SELECT top.experiment, CAST(top.rank AS BIGINT) AS rank,
         CASE WHEN top.parent_guid = root.root_guid THEN 'Process_Root'
              ELSE 'Process_' || CAST(top.rank AS VARCHAR) END AS process_id,
         coalesce(top.parent_guid = root.root_guid, false) AS is_root,
         CAST(top.total_actions AS BIGINT) AS total_actions,
         CAST(coalesce(fo.children, 0) AS BIGINT) AS children_spawned,
         bd.action_text
  FROM top LEFT JOIN root ON root.experiment = top.experiment
  LEFT JOIN fo ON fo.experiment = top.experiment AND fo.parent_guid = top.parent_guid
  LEFT JOIN bd ON bd.experiment = top.experiment AND bd.parent_guid = top.parent_guid)"""


@register("top_processes", O.q("SELECT * FROM topp", O.ROOT, O.EDGES, O.FANOUT, TOP))
def _top_processes(i: Inputs):
    return processes.top_processes(i.trace).drop("action_breakdown")


@register("bigrams", O.q("SELECT * FROM bgc", O.BIGRAMS))
def _bigrams(i: Inputs):
    return sequence.bigrams(i.trace)


@register("markov_probs", O.q("""
SELECT bgc.experiment, bgc.a, bgc.b, bgc.n, round(bgc.n / o.n_a, 9) AS p
FROM bgc JOIN (SELECT experiment, a, sum(n) AS n_a FROM bgc GROUP BY experiment, a) o
  ON o.experiment = bgc.experiment AND o.a = bgc.a""", O.BIGRAMS))
def _markov(i: Inputs):
    return sequence.markov_probs(i.trace)


@register("transition_entropy", O.q("""
SELECT experiment, CAST(sum(n) AS BIGINT) AS transitions, count(*) AS unique_transition_types,
       round(-sum((n / tot) * log2(n / tot)), 6) AS transition_entropy
FROM (SELECT *, sum(n) OVER (PARTITION BY experiment) AS tot FROM bgc) GROUP BY experiment""", O.BIGRAMS))
def _entropy(i: Inputs):
    return sequence.transition_stats(i.trace)


@register("rle_runs", O.q("SELECT * FROM runs", O.STARTS))
def _rle_runs(i: Inputs):
    return sequence.rle_runs(i.trace)


@register("rle_text", O.q("""
SELECT experiment, CAST(count(*) AS BIGINT) AS n_runs,
       string_agg(CASE WHEN run_no <= 40 THEN
                    CASE WHEN run_len > 1 THEN rule || ' x' || CAST(run_len AS VARCHAR) ELSE rule END END,
                  ' -> ' ORDER BY run_no)
       || CASE WHEN count(*) > 40
               THEN ' -> ... [' || CAST(count(*) - 40 AS VARCHAR) || ' further event runs omitted]'
               ELSE '' END AS flow
FROM runs GROUP BY experiment""", O.STARTS))
def _rle_text(i: Inputs):
    return sequence.rle_text(i.trace)


def _ngram_sql() -> str:
    g = ["g1 AS (SELECT experiment, run_no, rule AS gram FROM runs)"]
    for n in (2, 3, 4):
        g.append(f"""g{n} AS (SELECT a.experiment, a.run_no, a.gram || ' ' || b.rule AS gram
  FROM g{n - 1} a JOIN runs b ON b.experiment = a.experiment AND b.run_no = a.run_no + {n - 1})""")
    sel = "\nUNION ALL\n".join(
        f"SELECT experiment, CAST({n} AS INTEGER) AS n, gram, count(*) AS cnt FROM g{n} GROUP BY experiment, gram"
        for n in (2, 3, 4))
    return O.q(sel, O.STARTS, ",\n".join(g))


@register("rle_ngrams", _ngram_sql())
def _rle_ngrams(i: Inputs):
    return sequence.rle_ngrams(i.trace)
