"""Writers (SNK-01..09).  All writes are idempotent overwrites or appends of
whole tables/partitions, so a retried job leaves the same result."""

from __future__ import annotations

import hashlib
import json
import platform

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_feature_matrix(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SNK-01."""
    w = df.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


def write_predictions(df: DataFrame, path: str, partition_by: str | None = "config") -> None:
    """SNK-02: per-sample predictions, one folder per config (dynamic partition overwrite)."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if partition_by and partition_by in df.columns:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def stack_metrics(*tables: DataFrame) -> DataFrame:
    """SNK-03: metric tables of different shapes stacked, stored row first."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write_metrics(df: DataFrame, path: str) -> None:
    """SNK-03: one folder of CSV; a metric table has a row per group and model, so few parts."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def write_audit(df: DataFrame, path: str) -> None:
    """SNK-04: the audit log (no label column allowed); only the configurations in ``df`` are replaced."""
    if any(c in df.columns for c in ("label", "ground_truth", "true_label")):
        raise ValueError("audit rows must not carry ground truth")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("config").parquet(path)


def write_summary_jsonl(summary_records: DataFrame, path: str) -> None:
    """SNK-05: ``{experiment_id, summary, text}`` JSON lines, one folder per shard; ``summary`` is an object.

    Writing some shards leaves the others as they are.
    """
    from trailfold.schemas import SUMMARY_JSON
    out = summary_records.select(
        "shard_id", "experiment_id",
        F.from_json("json_data", SUMMARY_JSON).alias("summary"), F.col("text_repr").alias("text"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard_id").json(path)


def upsert(current: DataFrame, updates: DataFrame, key: str, order_col: str) -> DataFrame:
    """SNK-06/08: last write wins per ``key`` (union of versions + latest by ``order_col``)."""
    from trailfold.functions.ranking import latest_per_key
    u = current.unionByName(updates, allowMissingColumns=True)
    return latest_per_key(u, key, [order_col]).select(*u.columns)


def write_summary_store(summary_records: DataFrame, path: str) -> None:
    """SNK-06: the store partitioned by ``shard_id``; rewriting a shard replaces only that partition."""
    (summary_records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("shard_id").parquet(path))


def sample_rows(df: DataFrame, key: str, first: int = 50, every: int = 500) -> DataFrame:
    """SNK-07: first ``first`` rows by key, and those whose position counted from 0 divides by ``every``."""
    from trailfold.functions.ranking import position_within
    p = position_within(df.withColumn("_g", F.lit(0)), ["_g"], [F.col(key)])
    return p.where((F.col("pos") <= first) | ((F.col("pos") - 1) % every == 0)).drop("_g", "pos")


def manifest(spark: SparkSession, inputs: list[str], params: dict, code_paths: list[str]) -> DataFrame:
    """SNK-09: provenance manifest — versions, parameters, sha256 of code, input path/size/mtime.

    File facts come from the ``binaryFile`` source (distributed); only the
    small per-file metadata rows reach the result.
    """
    files = (spark.read.format("binaryFile").load(inputs)
             .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")))
    code = (spark.read.format("binaryFile").load(code_paths)
            .select(F.col("path").alias("code_path"), F.sha2(F.col("content"), 256).alias("sha256")))
    meta = {"python": platform.python_version(), "spark": spark.version, "params": params,
            "params_sha256": hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()}
    return (files.select(F.lit("input").alias("kind"), F.col("path").alias("name"),
                         F.col("size").cast("string").alias("value"), F.col("mtime").cast("string").alias("extra"))
            .unionByName(code.select(F.lit("code").alias("kind"), F.col("code_path").alias("name"),
                                     F.col("sha256").alias("value"), F.lit(None).cast("string").alias("extra")))
            .unionByName(spark.createDataFrame([("meta", "run", json.dumps(meta, sort_keys=True), None)],
                                               "kind string, name string, value string, extra string")))
