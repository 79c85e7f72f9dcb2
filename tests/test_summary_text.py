"""Exact layout of the rendered summary text and the retrieval demonstration block."""

import json

from helpers import det, pc, trace

from trailfold.operators import retrieval, summary

EXPECTED = """=== Dynamic Execution Trace Summary (Experiment: 5) ===
Execution Metrics: 4 total events | Duration: 2.5s | Avg Rate: 1.6 ev/s | Peak Rate: 2 ev/s

--- Event Counts by Rule ---
  - detonation: 1
  - process_create: 1
  - net_connect: 1
  - file_create: 1

--- Entity Diversity Counts ---
  - processes: 2
  - unique_files_created: 1
  - unique_images_loaded: 0
  - unique_registry_keys: 0
  - unique_network_connections: 1

--- Process Tree Structure ---
  - Total Processes Involved: 2
  - Max Process Tree Depth: 2
  - Max Branching Factor: 1
  - Root Process Direct Children: 1

--- Top Active Process Profiles ---
  * Process_Root (Root Detonation Binary): 2 actions, spawned 1 child processes
    Actions: process_create: 1, file_create: 1
  * Process_2: 1 actions, spawned 0 child processes
    Actions: net_connect: 1

--- Chronological Event Flow (Run-Length Encoded) ---
  detonation -> process_create -> net_connect -> file_create"""


def _trace(spark):
    return trace(spark, [det(0.0, "r"), pc("r", "c", 1.5), (2.0, "net_connect", "c", None, "1.2.3.4:443"),
                         (2.5, "file_create", "r", None, "f1")], experiment="5")


def test_summary_text_layout(spark):
    s = summary.with_text(summary.trace_summary(_trace(spark))).collect()[0]
    assert s.text_repr == EXPECTED
    rec = summary.summary_record(summary.trace_summary(_trace(spark))).collect()[0]
    data = json.loads(rec.json_data)       # map order as stored (first appearance)
    assert list(data["rule_counts"]) == ["detonation", "process_create", "net_connect", "file_create"]
    assert data["process_tree"]["max_tree_depth"] == 2 and data["top_processes"][0]["process_id"] == "Process_Root"


def test_demo_block_layout(spark):
    s = summary.trace_summary(_trace(spark))
    nb = spark.createDataFrame([(99, 1, 5, 0.1)], "target_id long, rank int, neighbor_id long, distance double")
    labels = spark.createDataFrame([(5, "malicious")], "id long, label string")
    block = retrieval.demo_blocks(nb, s, labels).collect()[0].reference_block
    rules = json.dumps({"detonation": 1, "process_create": 1, "net_connect": 1, "file_create": 1})
    ents = json.dumps({"processes": 2, "unique_files_created": 1, "unique_images_loaded": 0,
                       "unique_registry_keys": 0, "unique_network_connections": 1})
    assert block == ("Reference Sample (Historical ID: 5):\n"
                     "  - Total Events: 4, Duration: 2.5s\n"
                     f"  - Event Rules: {rules}\n"
                     "  - Process Tree Depth: 2, Branching: 1\n"
                     f"  - Entity Diversity: {ents}\n"
                     "  Verified Classification: malicious\n")
