"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailfold.llm.common import saved

#: As few edges as this (some MB) are connected in one task; rounds of jobs would cost more to start than to run.
FEW = 200_000
#: Nodes that a task remembers at once.
AT_ONCE = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b: long); the component is its smallest node.

    Each task first puts a spanning forest in place of its own edges.  If more
    than ``FEW`` are left, large-star and small-star steps follow in turn: each
    links a node's neighbours to the smallest of them, until every node hangs
    on its component's smallest one.  A step's least neighbours are written out
    before they are joined back, so the join has an exchange on either side and
    AQE can split a node with very many neighbours.  Loops and repeated edges
    are allowed; no edges give no rows.
    """
    now = saved(edges.select("a", "b").filter(F.col("a") != F.col("b")).mapInArrow(_forest, "a long, b long"))
    if now.count() <= FEW:
        return now.coalesce(1).mapInArrow(lambda batches: _forest(batches, roots=True), "a long, b long").toDF("node", "component")
    now = saved(now.distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        # large star: every larger neighbour of a node goes to the node's smallest neighbour or itself
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = (both.filter(F.col("b") > F.col("a")).join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        large = saved(large)
        # small star: a node and its smaller neighbours go to the smallest of them
        least = saved(large.groupBy("a").agg(F.min("b").alias("m")))
        joined = large.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = saved(joined.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _forest(batches: Iterator[pa.RecordBatch], roots: bool = False) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) that connect the same nodes: each node's to the smallest one that it is connected with here.

    ``roots``: these have an edge to themselves.
    """
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def stars() -> pa.RecordBatch:
        nodes = [x for x in root if roots or find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["a", "b"])

    for batch in batches:
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        if len(root) > AT_ONCE:
            yield stars()
            root.clear()
    yield stars()
