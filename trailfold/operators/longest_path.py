"""Longest simple paths from the roots of directed graphs, all graphs at once (TR-03).

A simple path enters a strongly connected component at most once, so the
search splits: simple paths are listed only inside a component, and what lies
between components has no cycle and is walked with one row per node.  A
graph without cycles is never listed path by path, however many paths it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailfold.operators.sequence import bigrams
from trailfold.operators.tree import CHECKPOINT_EVERY, _depths_by_level, _together
from trailfold.session import materialize

KEY = ["experiment", "node"]
#: A component of as few nodes is searched in one row's task, over bit sets of its nodes.
SMALL = 12
#: Entries of such components that are searched side by side.
SIDE_BY_SIDE = 1024


def longest_paths(edges: DataFrame, roots: DataFrame, reached: DataFrame) -> DataFrame:
    """``experiment, d``: nodes on the longest simple path from each experiment's root.

    ``edges`` (experiment, node, child) are distinct, ``roots`` has one row per
    experiment (experiment, node) and ``reached`` the nodes that a root
    reaches (experiment, node).  A root that is null or without edges gives 1.

    The jobs grow with the longest path.  The rows of a component grow with
    its sets of nodes (2^n at worst: the problem has no better way), those of
    everything else with edges times levels.
    """
    edges = materialize(edges.where(F.col("node") != F.col("child")).join(reached.select(*KEY), KEY, "left_semi"))
    members = materialize(components(edges))
    of = lambda end, name: members.select("experiment", F.col("node").alias(end), F.col("comp").alias(name))
    edges = materialize(edges.join(of("node", "comp"), KEY, "left")
                        .join(of("child", "child_comp"), ["experiment", "child"], "left"))
    same = F.coalesce(F.col("comp") == F.col("child_comp"), F.lit(False))
    between = edges.where(~same)
    entries = (between.where(F.col("child_comp").isNotNull()).select("experiment", F.col("child").alias("node"))
               .unionByName(roots.select(*KEY).join(members, KEY, "left_semi")).distinct())
    whole = ["experiment", "comp"]
    wide = members.groupBy(*whole).agg(F.count(F.lit(1)).alias("nodes")).where(F.col("nodes") > SMALL).select(*whole)
    wide = materialize(members.join(wide, whole, "left_semi"))
    inner = edges.where(same)
    spans = _small_spans(inner.join(wide, KEY, "left_anti"), entries.join(members, KEY).join(wide, KEY, "left_anti"))
    if not wide.isEmpty():
        spans = spans.unionByName(_spans(inner.join(wide, KEY, "left_semi"), entries.join(wide, KEY, "left_semi")))
    spans = materialize(spans)
    hops = materialize(between.join(spans, KEY, "left")
                       .groupBy("experiment", F.coalesce("entry", "node").alias("node"), "child")
                       .agg(F.max(F.coalesce("length", F.lit(1))).alias("length")))
    ends = materialize(spans.groupBy("experiment", F.col("entry").alias("node")).agg(F.max("length").alias("most")))
    return _walked(hops, ends, roots)


def _walked(hops: DataFrame, ends: DataFrame, roots: DataFrame) -> DataFrame:
    """Longest walk over ``hops``, which have no cycle: after r rounds a node holds the most nodes that r hops pass."""
    front = roots.select(*KEY, F.lit(0).alias("before"))
    bests = []
    while True:
        bests.append(front.join(ends, KEY, "left").groupBy("experiment")
                     .agg(F.max(F.col("before") + F.coalesce("most", F.lit(1))).alias("d")))
        if len(bests) > CHECKPOINT_EVERY:
            bests = [materialize(_together(bests).groupBy("experiment").agg(F.max("d").alias("d")))]
        front = materialize(front.join(hops, KEY).groupBy("experiment", F.col("child").alias("node"))
                            .agg(F.max(F.col("before") + F.col("length")).alias("before")))
        if front.isEmpty():
            return _together(bests).groupBy("experiment").agg(F.max("d").alias("d"))


def _spans(inner: DataFrame, entries: DataFrame) -> DataFrame:
    """``experiment, entry, node, length``: the longest simple path inside a component from where it is entered.

    Two paths that passed the same nodes and ended at the same one go on alike: one of them is kept.
    """
    paths = materialize(entries.select("experiment", F.col("node").alias("entry"), "node", F.array("node").alias("passed")))
    found = []
    while not paths.isEmpty():
        found.append(paths.select("experiment", "entry", "node", F.size("passed").alias("length")).distinct())
        if len(found) > CHECKPOINT_EVERY:
            found = [materialize(_longest(found))]
        paths = materialize(paths.join(inner.select(*KEY, "child"), KEY)
                            .where(~F.array_contains("passed", F.col("child")))
                            .select("experiment", "entry", F.col("child").alias("node"),
                                    F.array_sort(F.array_append("passed", F.col("child"))).alias("passed")).distinct())
    return _longest(found or [paths.select("experiment", "entry", "node", F.size("passed").alias("length"))])


def _small_spans(inner: DataFrame, entries: DataFrame) -> DataFrame:
    """``_spans`` for components of at most ``SMALL`` nodes; both tables name the component (comp) as well.

    A row holds one component and one of its entries: the states of the search,
    many times the edges, stay in the task.
    """
    graphs = inner.groupBy("experiment", "comp").agg(F.collect_list(F.struct("node", "child")).alias("e"))
    ends = lambda end: F.coalesce(F.col(f"e.{end}"), F.array().cast(f"array<{kind}>"))
    kind = entries.schema["node"].dataType.simpleString()
    asked = (entries.join(graphs, ["experiment", "comp"], "left")
             .select("experiment", F.col("node").alias("entry"), F.array_append(ends("node"), F.col("node")).alias("a"),
                     F.array_append(ends("child"), F.col("node")).alias("b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SIDE_BY_SIDE):
                batch = whole.slice(at, SIDE_BY_SIDE)
                a, b = batch.column("a"), batch.column("b")
                ends = pa.concat_arrays([batch.column("entry"), a.flatten(), b.flatten()]).dictionary_encode()
                code, n = ends.indices.to_numpy(zero_copy_only=False).astype(np.int64), batch.num_rows
                row = np.repeat(np.arange(n), a.value_lengths().to_numpy(zero_copy_only=False))
                owner = np.concatenate([np.arange(n), row, row])
                nodes, place = np.unique(owner * len(ends.dictionary) + code, return_inverse=True)
                of = nodes // len(ends.dictionary)
                place = place - np.searchsorted(of, owner)
                length = _longest_by_bits(n, place[:n], row, place[n:n + len(row)], place[n + len(row):])
                node = np.arange(len(nodes)) - np.searchsorted(of, of)
                got = np.flatnonzero(length[node, of])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("experiment").take(pa.array(of[got])), batch.column("entry").take(pa.array(of[got])),
                     ends.dictionary.take(pa.array(nodes[got] % len(ends.dictionary))),
                     pa.array(length[node[got], of[got]].astype(np.int32))], ["experiment", "entry", "node", "length"])

    name = entries.schema["experiment"].dataType.simpleString()
    return asked.mapInArrow(run, f"experiment {name}, entry {kind}, node {kind}, length int")


def _longest_by_bits(n: int, start: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Nodes on the longest simple path to each node (first axis) of ``n`` graphs (second), 0 where there is none.

    ``start``: the graphs' first nodes; ``row``, ``a``, ``b``: edges.  For each
    set of nodes, the nodes at which a path that passed just these can end are
    one number of bits; a set is reached from those that lack one of its nodes.
    """
    size = int(max(start.max(initial=0), a.max(initial=0), b.max(initial=0))) + 1
    into = np.zeros((size, n), np.int64)
    np.bitwise_or.at(into, (b, row), 1 << a)
    ends = np.zeros((1 << size, n), np.int16)
    ends[1 << start, np.arange(n)] = 1 << start
    length = np.zeros((size, n), np.int64)
    into = into.astype(np.int16)
    for passed in range(1, 1 << size):
        now = ends[passed]
        for v in range(size):
            if passed >> v & 1 and passed != 1 << v:
                now |= ((ends[passed ^ 1 << v] & into[v]) != 0).astype(np.int16) << np.int16(v)
        if not now.any():
            continue
        for v in range(size):
            if passed >> v & 1:
                np.maximum(length[v], np.where(now >> np.int16(v) & 1, passed.bit_count(), 0), out=length[v])
    return length


def _longest(found: list[DataFrame]) -> DataFrame:
    return _together(found).groupBy("experiment", "entry", "node").agg(F.max("length").alias("length"))


def components(edges: DataFrame) -> DataFrame:
    """``experiment, node, comp`` for every node on a cycle: its strongly connected component.

    What no cycle needs is trimmed off.  Each node left takes the largest node
    that reaches it as its colour; the nodes of one colour that lead back to
    the node of that name are one component.  They go, and the rest starts
    anew.  Nodes on a way between two cycles may come out as components of
    their own.
    """
    found = []
    core = _trimmed(edges)
    while not core.isEmpty():
        colour = _colours(core)
        to = colour.select("experiment", F.col("node").alias("child"), F.col("comp").alias("child_comp"))
        back = materialize(core.join(colour, KEY).join(to, ["experiment", "child"]).where(F.col("comp") == F.col("child_comp"))
                           .select("experiment", F.col("child").alias("node"), F.col("node").alias("child")))
        inside = _depths_by_level(back, colour.where(F.col("comp") == F.col("node")))
        members = materialize(inside.select(*KEY).join(colour, KEY))
        found.append(members)
        core = _trimmed(core.join(members, KEY, "left_anti")
                        .join(members.select("experiment", F.col("node").alias("child")), ["experiment", "child"], "left_anti"))
    return _together(found) if found else core.select("experiment", "node", F.col("node").alias("comp"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges that remain when nodes without a way in or without a way out have gone, again and again."""
    edges = materialize(edges)
    left = edges.count()
    while left:
        less = materialize(edges.join(edges.select("experiment", F.col("child").alias("node")), KEY, "left_semi")
                           .join(edges.select("experiment", F.col("node").alias("child")), ["experiment", "child"], "left_semi"))
        n = less.count()
        if n == left:
            break
        edges, left = less, n
    return edges


def _colours(edges: DataFrame) -> DataFrame:
    """``experiment, node, comp``: the largest node that reaches each node, itself included."""
    ends = edges.select(*KEY).unionByName(edges.select("experiment", F.col("child").alias("node"))).distinct()
    colour = changed = materialize(ends.withColumn("comp", F.col("node")))
    while True:
        offers = (changed.join(edges, KEY).groupBy("experiment", F.col("child").alias("node"))
                  .agg(F.max("comp").alias("offer")))
        better = materialize(colour.join(offers, KEY).where(F.col("offer") > F.col("comp"))
                             .select(*KEY, F.col("offer").alias("comp")))
        if better.isEmpty():
            return colour
        colour = materialize(colour.join(better.withColumnRenamed("comp", "offer"), KEY, "left")
                             .select(*KEY, F.coalesce("offer", "comp").alias("comp")))
        changed = better


def rule_chain(trace: DataFrame) -> DataFrame:
    """``experiment, longest_chain``: most different rules in a chain from the first event's rule, in which each
    rule follows the one before it somewhere in the trace (TR-03 on the graph of WN-06)."""
    pairs = materialize(bigrams(trace).select("experiment", F.col("a").alias("node"), F.col("b").alias("child")))
    roots = materialize(trace.where(F.col("ingest_seq") == 1).select("experiment", F.col("RuleName").alias("node")))
    best = longest_paths(pairs, roots, _depths_by_level(pairs, roots))
    return best.select("experiment", F.col("d").cast("long").alias("longest_chain"))
