"""Process trees: edges, root selection, fan-out, depth (two variants).

Depth is computed for all experiments at once: by pointer doubling where every
child has one parent (rounds grow with the logarithm of the depth), else by a
level-synchronous search (cycle-safe through anti-joins on the visited nodes).
Lineage is cut with reliable ``checkpoint()`` into the session's checkpoint
folder.
"""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailfold.operators.entities import process_counts
from trailfold.operators.folds import by_experiment, by_process
from trailfold.session import checkpoint_dir, materialize

CHECKPOINT_EVERY = 4


def tree_edges(trace: DataFrame) -> DataFrame:
    """TR-01: ``experiment, parent_guid, child_guid`` from ``process_create``; duplicates kept."""
    return (trace.where((F.col("RuleName") == "process_create") & F.col("parent_guid").isNotNull()
                        & F.col("child_guid").isNotNull())
            .select("experiment", "parent_guid", "child_guid"))


def root_process(trace: DataFrame) -> DataFrame:
    """WN-04: ``experiment, root_guid`` — the last detonation's child, else the first event's parent."""
    return by_experiment(trace).select("experiment", "root_guid")


def fanout(trace: DataFrame) -> DataFrame:
    """AG-08 input: ``experiment, parent_guid, children`` (edge count, duplicates counted)."""
    return (by_process(trace).where(F.col("parent_guid").isNotNull() & (F.col("children") > 0))
            .groupBy("experiment", "parent_guid").agg(F.sum("children").alias("children")))


def tree_fanout(trace: DataFrame) -> DataFrame:
    """AG-08/09: ``experiment, max_branching_factor, root_spawned_children``."""
    fo = fanout(trace)
    mx = fo.groupBy("experiment").agg(F.max("children").alias("max_branching_factor"))
    roots = root_process(trace)
    rc = (fo.join(roots, (fo.experiment == roots.experiment) & (fo.parent_guid == roots.root_guid))
          .select(fo.experiment, F.col("children").alias("root_spawned_children")))
    return (roots.select("experiment")
            .join(mx, "experiment", "left").join(rc, "experiment", "left")
            .select("experiment",
                    F.coalesce("max_branching_factor", F.lit(0)).cast("long").alias("max_branching_factor"),
                    F.coalesce("root_spawned_children", F.lit(0)).cast("long").alias("root_spawned_children")))


_DEPTHS: "weakref.WeakKeyDictionary[DataFrame, DataFrame]" = weakref.WeakKeyDictionary()


def node_depths(trace: DataFrame) -> DataFrame:
    """TR-02: ``experiment, node, depth`` — BFS hop count from the root + 1, cycle-safe.

    Memoised per trace DataFrame (several operators need them); the work is done by ``depths``.
    """
    hit = _DEPTHS.get(trace)
    if hit is not None:
        return hit
    checkpoint_dir(trace.sparkSession)
    edges = materialize(_child_edges(trace))
    roots = materialize(root_process(trace).select("experiment", F.col("root_guid").alias("node")))
    _DEPTHS[trace] = state = depths(edges, roots)
    return state


def _child_edges(trace: DataFrame) -> DataFrame:
    return (tree_edges(trace).select("experiment", F.col("parent_guid").alias("node"), F.col("child_guid").alias("child"))
            .repartition("experiment", "node").distinct())


def no_trees(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Experiments in which a child has several parents or the root has one."""
    parents = edges.groupBy("experiment", "child").agg(F.count(F.lit(1)).alias("parents"))
    return (parents.where(F.col("parents") > 1).select("experiment")
            .unionByName(edges.select("experiment", F.col("child").alias("node")).join(roots, ["experiment", "node"]).select("experiment"))
            .distinct())


def depths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``experiment, node, depth`` from distinct ``edges`` (experiment, node, child) and ``roots`` (experiment, node).

    Where every child has one parent a node's depth is the length of its way
    up, found by pointer doubling: a depth of d takes about log2(d) rounds.
    Other experiments are searched level by level.
    """
    odd = materialize(no_trees(edges, roots))
    found = [_depths_by_doubling(edges.join(odd, "experiment", "left_anti"), roots.join(odd, "experiment", "left_anti"))]
    if not odd.isEmpty():
        found.append(_depths_by_level(materialize(edges.join(odd, "experiment", "left_semi")), roots.join(odd, "experiment", "left_semi")))
    return _together(found)


def _depths_by_doubling(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Depths where every child has one parent and no root has one.

    Each node points to an ancestor some hops up; in a round a pointer takes
    over the pointer of where it ends, which doubles its length.  Pointers that
    end at a node without a parent are done and leave the rounds.  Nodes on a
    cycle never end: after as many rounds as the longest way can need, what is
    left is reached by no root.
    """
    key = ["experiment", "anc"]
    active = materialize(edges.select("experiment", F.col("child").alias("node"), F.col("node").alias("anc"),
                                      F.lit(1).cast("long").alias("hops")))
    done = []
    for _ in range(active.count().bit_length() + 1):
        all_of_them = _together([active, *done])
        on = all_of_them.select("experiment", F.col("node").alias("anc"), F.col("anc").alias("next"), F.col("hops").alias("more"))
        step = materialize(active.join(on, key, "left")
                           .select("experiment", "node", F.coalesce("next", "anc").alias("anc"),
                                   (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("next").isNull().alias("ends")))
        done.append(step.where("ends").drop("ends"))
        active = step.where("not ends").drop("ends")
        if active.isEmpty():
            break
    tops = roots.withColumnRenamed("node", "anc")
    below = _together(done).join(tops, key) if done else None
    first = roots.select("experiment", "node", F.lit(1).alias("depth"))
    if below is None:
        return first
    return first.unionByName(below.select("experiment", "node", (F.col("hops") + 1).cast("int").alias("depth")))


def _depths_by_level(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Depths by a level-synchronous search of all experiments at once, which ends at cycles.

    The nodes of a level are written once and never touched again: the next
    level is the frontier joined with the edges, without the nodes of earlier
    levels.  A level costs one job and shuffles the frontier.
    """
    key = ["experiment", "node"]
    frontier = materialize(roots.select("experiment", "node", F.lit(1).alias("depth")))
    visited, recent, level = frontier, [], 1
    while True:
        found = (frontier.where(F.col("node").isNotNull()).join(edges, key)
                 .select("experiment", F.col("child").alias("node")).distinct())
        for seen in [visited, *recent]:
            found = found.join(seen.select(*key), key, "left_anti")
        level += 1
        frontier = materialize(found.withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        recent.append(frontier)
        if len(recent) == CHECKPOINT_EVERY:
            # a few levels are put into one table, so that a level has a bounded number of joins
            visited, recent = _together([visited, *recent]), []
    return _together([visited, *recent])


def _together(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for part in levels[1:]:
        out = out.unionByName(part)
    return out


def tree_depth(trace: DataFrame) -> DataFrame:
    """TR-02: ``experiment, max_tree_depth``."""
    return node_depths(trace).groupBy("experiment").agg(F.max("depth").cast("long").alias("max_tree_depth"))


def tree_depth_dfs(trace: DataFrame) -> DataFrame:
    """TR-03 (variant B): longest *simple* path from the root, counted in nodes.

    Where every child of an experiment has one parent and none is the root,
    what the root reaches is a tree, and the longest path is the BFS depth.
    The other experiments go through ``longest_path``: paths are listed only
    inside strongly connected components, what lies between them is walked.
    """
    from trailfold.operators.longest_path import longest_paths
    checkpoint_dir(trace.sparkSession)
    edges = materialize(_child_edges(trace))
    roots = root_process(trace).select("experiment", F.col("root_guid").alias("node"))
    odd = materialize(no_trees(edges, roots))
    reached = node_depths(trace)
    best = (reached.join(odd, "experiment", "left_anti").groupBy("experiment").agg(F.max("depth").alias("d")))
    if not odd.isEmpty():
        best = best.unionByName(longest_paths(edges.join(odd, "experiment", "left_semi"),
                                              materialize(roots.join(odd, "experiment", "left_semi")), reached))
    return best.select("experiment", F.col("d").cast("long").alias("max_tree_depth"))


def process_tree(trace: DataFrame) -> DataFrame:
    """TR-04: ``experiment, total_processes, max_tree_depth, max_branching_factor, root_spawned_children``."""
    p = process_counts(trace)
    d = tree_depth(trace)
    f = tree_fanout(trace)
    return (f.join(d, "experiment", "left").join(p, "experiment", "left")
            .select("experiment",
                    F.coalesce("processes", F.lit(0)).cast("long").alias("total_processes"),
                    F.coalesce("max_tree_depth", F.lit(1)).cast("long").alias("max_tree_depth"),
                    "max_branching_factor", "root_spawned_children"))
