"""Provenance graph tables (GR-01/02): typed nodes and edges per experiment.

Edges come from one projection of the event table (rule → edge type is a
``CASE`` expression, no lookup join); node features are degree aggregates
joined with the BFS depth of ``tree.node_depths``.  The tables are the
input of a graph learner; no learner is built here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailfold.operators import rates, tree

# --- fixed values: edge typing (the spec lists 8 edge types; reg_delete_value is kept as a 9th) ---
EDGE_DST_TYPE = {
    "process_create": "Process",
    "process_term": "Process",
    "file_create": "File",
    "image_load": "File",
    "reg_create_key": "RegistryKey",
    "reg_write": "RegistryKey",
    "reg_delete_key": "RegistryKey",
    "reg_delete_value": "RegistryKey",
    "net_connect": "NetworkSocket",
}
# --- end fixed values ---


def _dst_type():
    c = None
    for rule, t in EDGE_DST_TYPE.items():
        c = (F.when(F.col("RuleName") == rule, F.lit(t)) if c is None
             else c.when(F.col("RuleName") == rule, F.lit(t)))
    return c


def edge_rows(trace: DataFrame) -> DataFrame:
    """One typed edge per event: ``experiment, src, edge_type, dst_type, dst, offset_us``."""
    off = rates.relative_offsets(trace)
    dtype = _dst_type()
    dst = F.when(dtype == "Process", F.coalesce("child_guid", "child_name")).otherwise(F.col("child_name"))
    return (off.where(F.col("parent_guid").isNotNull() & dtype.isNotNull())
            .select("experiment", F.col("parent_guid").alias("src"), F.col("RuleName").alias("edge_type"),
                    dtype.alias("dst_type"), dst.alias("dst"), "offset_us")
            .where(F.col("dst").isNotNull()))


def prov_edges(trace: DataFrame) -> DataFrame:
    """GR-01: ``experiment, src_type, src, edge_type, dst_type, dst, n`` (multiplicity)."""
    return (edge_rows(trace).groupBy("experiment", "src", "edge_type", "dst_type", "dst")
            .agg(F.count(F.lit(1)).alias("n"))
            .select("experiment", F.lit("Process").alias("src_type"), "src", "edge_type", "dst_type", "dst", "n"))


def prov_node_features(trace: DataFrame) -> DataFrame:
    """GR-02: ``experiment, node_type, node, in_degree, out_degree, depth, first_seen_us, active_us, act_<rule>…``.

    Degrees count edges with multiplicity; ``depth`` is the BFS depth from
    the root for process nodes reached from it (NULL otherwise).
    """
    e = edge_rows(trace)
    outs = e.select("experiment", F.lit("Process").alias("node_type"), F.col("src").alias("node"),
                    F.lit(0).alias("i"), F.lit(1).alias("o"), "offset_us")
    ins = e.select("experiment", F.col("dst_type").alias("node_type"), F.col("dst").alias("node"),
                   F.lit(1).alias("i"), F.lit(0).alias("o"), "offset_us")
    nodes = outs.unionByName(ins).groupBy("experiment", "node_type", "node").agg(
        F.sum("i").cast("long").alias("in_degree"), F.sum("o").cast("long").alias("out_degree"),
        F.min("offset_us").alias("first_seen_us"),
        (F.max("offset_us") - F.min("offset_us")).alias("active_us"))
    depth = (tree.node_depths(trace).where(F.col("node").isNotNull())
             .groupBy("experiment", "node").agg(F.min("depth").cast("long").alias("depth"))
             .withColumn("node_type", F.lit("Process")))
    # action vector of a process node: its outgoing events per rule (0 for entity nodes)
    acts = (e.groupBy("experiment", F.col("src").alias("node"))
            .agg(*[F.count_if(F.col("edge_type") == r).alias(f"act_{r}") for r in EDGE_DST_TYPE])
            .withColumn("node_type", F.lit("Process")))
    act_cols = [f"act_{r}" for r in EDGE_DST_TYPE]
    return (nodes.join(depth, ["experiment", "node_type", "node"], "left")
            .join(acts, ["experiment", "node_type", "node"], "left")
            .select("experiment", "node_type", "node", "in_degree", "out_degree", "depth", "first_seen_us",
                    "active_us", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in act_cols]))
