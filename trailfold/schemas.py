"""Fixed schemas and domain constants.  Raw inputs are never schema-inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: the event rule vocabulary, in the reference's feature order ---
FEATURES = [
    "process_create",
    "process_term",
    "reg_create_key",
    "reg_write",
    "file_create",
    "image_load",
    "reg_delete_key",
    "net_connect",
    "reg_delete_value",
]
ROOT_RULE = "detonation"
RULES = [ROOT_RULE] + FEATURES
LABELS = ["benign", "malicious"]
# --- end fixed values ---

EVENTS = T.StructType([
    T.StructField("experiment", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("RuleName", T.StringType()),
    T.StructField("parent_guid", T.StringType()),
    T.StructField("child_guid", T.StringType()),
    T.StructField("parent_name", T.StringType()),
    T.StructField("child_name", T.StringType()),
    T.StructField("shard_id", T.IntegerType()),
    T.StructField("ingest_seq", T.LongType()),
])

# The landed table: the event schema plus what is set once at landing, the predecessor's rule and the
# microseconds since the experiment's first event.
LANDED = T.StructType(EVENTS.fields + [T.StructField("prev_rule", T.StringType()),
                                       T.StructField("offset_us", T.LongType())])

# Raw shard rows as written by the tracer (JSON lines / array of records).
RAW_EVENTS = T.StructType([f for f in EVENTS.fields if f.name not in ("shard_id", "ingest_seq")])

LABELS_RAW = T.StructType([
    T.StructField("experiment", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("year", T.DoubleType()),
])

LABELS_SCHEMA = T.StructType([
    T.StructField("experiment", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("test", T.BooleanType()),
])

FEATURE_MATRIX = T.StructType(
    [T.StructField("experiment", T.StringType())]
    + [T.StructField(f, T.LongType()) for f in FEATURES]
    + [T.StructField("year", T.IntegerType()), T.StructField("label", T.StringType()),
       T.StructField("test", T.BooleanType())]
)

PREDICTIONS = T.StructType([
    T.StructField("experiment", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("label", T.StringType()),
    T.StructField("prediction", T.StringType()),
    T.StructField("malware_probability", T.DoubleType()),
    T.StructField("fold", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("status", T.StringType()),
])

REPLY = T.StructType([
    T.StructField("prediction", T.StringType()),
    T.StructField("malware_probability", T.DoubleType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("evidence", T.ArrayType(T.StringType())),
    T.StructField("uncertainty_reason", T.StringType()),
])

CACHE = T.StructType([
    T.StructField("cache_key", T.StringType()),
    T.StructField("experiment_id", T.StringType()),
    T.StructField("config_name", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("prompt_hash", T.StringType()),
    T.StructField("raw_response", T.StringType()),
    T.StructField("parsed_json", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("latency", T.DoubleType()),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
])

AUDIT_COLUMNS = [
    "experiment_id", "config", "model", "prompt_hash", "retrieved_ids", "status", "prediction",
    "malware_probability", "confidence", "latency_sec", "prompt_tokens", "completion_tokens",
    "evidence_count",
]

SUMMARY_JSON = T.StructType([
    T.StructField("experiment_id", T.StringType()),
    T.StructField("total_events", T.LongType()),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("avg_events_per_sec", T.DoubleType()),
    T.StructField("peak_events_per_sec", T.LongType()),
    T.StructField("rule_counts", T.MapType(T.StringType(), T.LongType())),
    T.StructField("entity_counts", T.StructType([T.StructField(n, T.LongType()) for n in (
        "processes", "unique_files_created", "unique_images_loaded", "unique_registry_keys",
        "unique_network_connections")])),
    T.StructField("process_tree", T.StructType([T.StructField(n, T.LongType()) for n in (
        "total_processes", "max_tree_depth", "max_branching_factor", "root_spawned_children")])),
    T.StructField("event_sequence_compressed", T.ArrayType(T.StringType())),
    T.StructField("top_processes", T.ArrayType(T.StructType([
        T.StructField("process_id", T.StringType()), T.StructField("is_root", T.BooleanType()),
        T.StructField("total_actions", T.LongType()), T.StructField("children_spawned", T.LongType()),
        T.StructField("action_breakdown", T.MapType(T.StringType(), T.LongType()))]))),
])
