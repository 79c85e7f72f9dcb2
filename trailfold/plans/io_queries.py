"""Registered source/sink round trips and remaining split/profile queries.

Round-trip queries write Spark-derived tables into a fresh folder under the
session's checkpoint folder and read them back through the library readers.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from trailfold.operators import counts, entities, splits, summary
from trailfold.plans import oracle as O
from trailfold.plans.catalog import register
from trailfold.plans.feature_queries import summary_figures_sql
from trailfold.schemas import SUMMARY_JSON
from trailfold.plans.inputs import Inputs
from trailfold.schemas import CACHE
from trailfold.session import checkpoint_dir
from trailfold.sources import readers, sinks


def _scratch(i: Inputs, name: str) -> str:
    base = checkpoint_dir(i.spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


@register("labels_union", O.q("SELECT experiment, label, year, test FROM labels_l"))
def _labels_union(i: Inputs):
    """SRC-01/SO-01: label lens written as two JSON files (train / test), read back tagged and stacked."""
    d = _scratch(i, "labels")
    lab = i.labels.select("experiment", "label", F.col("year").cast("double").alias("year"), "test")
    lab.where(~F.col("test")).drop("test").write.json(os.path.join(d, "train"))
    lab.where(F.col("test")).drop("test").write.json(os.path.join(d, "test"))
    return readers.load_labels(i.spark, os.path.join(d, "train"), os.path.join(d, "test"))


@register("summary_scan", summary_figures_sql("r.total_events, coalesce(depth.max_tree_depth, 1) AS max_tree_depth"))
def _summary_scan(i: Inputs):
    """SNK-06 + SRC-05: summary store written by shard, full scan with the JSON column decoded."""
    d = _scratch(i, "store")
    sinks.write_summary_store(summary.summary_record(summary.trace_summary(i.trace)), d)
    s = readers.read_summary_store(i.spark, d)
    return s.select("experiment_id", "shard_id", F.col("data.total_events").alias("total_events"),
                    F.col("data.process_tree.max_tree_depth").alias("max_tree_depth"))


_CACHE_SQL = """SELECT cache_key, status, prediction, malware_probability, confidence FROM (
  SELECT CAST(user_id AS VARCHAR) AS cache_key,
         CASE WHEN event_type = 'error' THEN 'validation_error: JSONDecodeError' ELSE 'success' END AS status,
         CASE WHEN event_type = 'click' THEN 'malicious' WHEN event_type = 'error' THEN NULL ELSE 'benign' END
           AS prediction,
         CASE WHEN event_type = 'error' THEN NULL ELSE CAST(value / 100.0 AS DOUBLE) END AS malware_probability,
         CASE WHEN event_type = 'error' THEN NULL ELSE CAST(0.5 AS DOUBLE) END AS confidence
  FROM events) WHERE status IN ('success', 'cached')"""


@register("cache_flatten", O.q(_CACHE_SQL))
def _cache_flatten(i: Inputs):
    """SNK-08 append + SRC-06: cache rows written as Parquet, scanned by model and status, JSON flattened."""
    e = i.table("events")
    pred = (F.when(F.col("event_type") == "click", "malicious").when(F.col("event_type") == "error", None)
            .otherwise("benign"))
    ok = F.col("event_type") != "error"
    parsed = F.when(ok, F.to_json(F.struct(pred.alias("prediction"),
                                           (F.col("value") / 100.0).alias("malware_probability"),
                                           F.lit(0.5).alias("confidence"))))
    rows = e.select(
        F.col("user_id").cast("string").alias("cache_key"), F.col("user_id").cast("string").alias("experiment_id"),
        F.lit("zero_shot").alias("config_name"), F.lit("mock").alias("model_name"),
        F.lit("").alias("prompt_hash"), F.col("props").alias("raw_response"), parsed.alias("parsed_json"),
        F.when(ok, "success").otherwise("validation_error: JSONDecodeError").alias("status"),
        F.lit(0.0).alias("latency"), F.lit(0).cast("long").alias("prompt_tokens"),
        F.lit(0).cast("long").alias("completion_tokens"), F.col("ts").cast("timestamp").alias("timestamp"))
    d = _scratch(i, "cache")
    rows.select(*[f.name for f in CACHE.fields]).write.parquet(d)
    c = readers.read_cache(i.spark, d, model="mock")
    return c.select("cache_key", "status", "prediction", "malware_probability", "confidence")


@register("eval_subset_2024", O.q("SELECT * FROM labels_l WHERE coalesce(year = 2024, false)"))
def _eval_2024(i: Inputs):
    return splits.eval_subset(i.labels, "2024")


@register("eval_subset_official", O.q("SELECT * FROM labels_l WHERE test"))
def _eval_official(i: Inputs):
    return splits.eval_subset(i.labels, "official_test")


@register("eval_subset_pilot", O.q("""
SELECT experiment, label, year, test FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY (CAST(experiment AS BIGINT) * 7919 + 42) % 1000003,
                               experiment) AS rn
  FROM labels_l WHERE coalesce(year = 2024, false)) WHERE rn <= 10"""))
def _eval_pilot(i: Inputs):
    """FLT-03 pilot_20: 10 per class from the 2024 cohort in a seeded arithmetic order."""
    order = [(F.col("experiment").cast("long") * 7919 + 42) % 1000003, F.col("experiment")]
    return splits.eval_subset(i.labels, "pilot_20", order=order)


@register("shard_rule_profile", O.q(
    "SELECT shard_id, RuleName AS rule, count(*) AS n FROM trace GROUP BY shard_id, RuleName"))
def _shard_rules(i: Inputs):
    """AG-24 value counts per shard."""
    return counts.shard_rule_profile(i.trace)


@register("process_set", O.q("""
SELECT DISTINCT experiment, g AS guid FROM (
  SELECT experiment, parent_guid AS g FROM trace
  UNION SELECT experiment, child_guid AS g FROM trace WHERE RuleName = 'process_create') WHERE g IS NOT NULL"""))
def _process_set(i: Inputs):
    """SO-04: union of parent and created-child guids per experiment."""
    return entities.process_set(i.trace)


@register("cohort_sizes", O.q("""
SELECT 'official_train' AS cohort, count_if(NOT test) AS n FROM labels_l
UNION ALL SELECT 'official_test', count_if(test) FROM labels_l
UNION ALL SELECT 'temporal_train', count_if(NOT test AND year IS DISTINCT FROM 2024) FROM labels_l
UNION ALL SELECT 'eval_2024', count_if(coalesce(year = 2024, false)) FROM labels_l
UNION ALL SELECT 'history_pool', count_if(NOT test AND coalesce(year < 2024, false)) FROM labels_l"""))
def _cohort_sizes(i: Inputs):
    """DQ-05: sizes of every cohort the protocol uses (compared to expected counts by the caller)."""
    lab = i.labels
    ts = splits.temporal_split(lab)
    parts = [
        ("official_train", lab.where(~F.col("test"))), ("official_test", lab.where(F.col("test"))),
        ("temporal_train", ts.where(F.col("split") == "train")),
        ("eval_2024", splits.eval_subset(lab, "2024")), ("history_pool", splits.history_pool(lab)),
    ]
    out: DataFrame | None = None
    for name, df in parts:
        c = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("cohort"), "n")
        out = c if out is None else out.unionByName(c)
    return out


@register("summary_jsonl", summary_figures_sql(
    "r.total_events, coalesce(depth.max_tree_depth, 1) AS max_tree_depth, coalesce(tn.n_top, 0) AS n_top, fl.flow, tx.text_repr AS text"))
def _summary_jsonl(i: Inputs):
    """SNK-05: per-shard JSON lines of ``{experiment_id, summary, text}``, read back."""
    d = _scratch(i, "jsonl")
    sinks.write_summary_jsonl(summary.summary_record(summary.trace_summary(i.trace)), d)
    record = StructType([StructField("experiment_id", StringType()), StructField("summary", SUMMARY_JSON),
                         StructField("text", StringType()), StructField("shard_id", IntegerType())])
    back = i.spark.read.schema(record).json(d)
    return back.select("experiment_id", "shard_id", "summary.total_events", "summary.process_tree.max_tree_depth",
                       F.size("summary.top_processes").cast("long").alias("n_top"),
                       F.array_join("summary.event_sequence_compressed", " -> ").alias("flow"), "text")
