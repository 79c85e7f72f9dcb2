"""Readers for the raw inputs (SRC-01..07), always with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailfold.schemas import CACHE, FEATURE_MATRIX, LABELS_RAW, LANDED, PREDICTIONS, RAW_EVENTS


def load_labels(spark: SparkSession, train_path: str, test_path: str, multiline: bool = False) -> DataFrame:
    """SRC-01: both label files, tagged ``test`` false/true, stacked (``unionByName``).

    ``year`` arrives as a float (NaN-able) and is kept as a nullable int.
    """
    def one(path: str, flag: bool) -> DataFrame:
        df = spark.read.schema(LABELS_RAW).option("multiLine", multiline).json(path)
        return df.select("experiment", "label",
                         F.when(F.isnan("year"), None).otherwise(F.col("year")).cast("int").alias("year"),
                         F.lit(flag).alias("test"))
    return one(train_path, False).unionByName(one(test_path, True))


def land_events(raw: DataFrame, order_col: str = "file_pos") -> DataFrame:
    """Landing: add ``ingest_seq`` = chronological position per experiment (ties in file order).

    Positions and the predecessor's rule (``prev_rule``) come from a global
    range sort with partition offsets (``running_within``), so a hot
    experiment is numbered by many tasks.
    Every order-sensitive operator afterwards joins on ``(experiment, ingest_seq)``.
    """
    from trailfold.functions.ranking import running_within
    at = F.unix_micros("timestamp")
    p = running_within(raw, ["experiment"], [F.col("timestamp"), F.col(order_col)], {}, pos="ingest_seq",
                       lags={"prev_rule": F.col("RuleName")}, least={"_start": at})
    return p.withColumn("offset_us", at - F.col("_start")).drop(order_col, "_start")


def land_table(landed: DataFrame, path: str) -> DataFrame:
    """SRC-02/ST-02: write landed events by shard, each file in (experiment, ingest_seq) order, and read them back.

    The partitioned write needs its rows sorted by ``shard_id``; sorting by
    that first keeps the order within a shard.
    """
    (landed.select(*[f.name for f in LANDED.fields]).sortWithinPartitions("shard_id", "experiment", "ingest_seq")
     .write.mode("overwrite").partitionBy("shard_id").parquet(path))
    return landed.sparkSession.read.schema(LANDED).parquet(path).select(*[f.name for f in LANDED.fields])


def shard_of(path: Column) -> Column:
    """The number of a shard's file or folder: the last ``<number>.json`` in its path; null without one."""
    return F.regexp_extract(path, r".*?(\d+)\.json(?:l|\.gz)?(?:/[^/]*)?$", 1).try_cast("int")


def read_trace_shards(spark: SparkSession, paths: list[str], multiline: bool = False) -> DataFrame:
    """SRC-02: all shards in one scan, ``shard_id`` from the file name, landed with ``ingest_seq``.

    ``land_table`` writes the result once, so that later scans do not land it again.

    JSON lines are splittable (many tasks per shard); a shard that is one
    JSON array needs ``multiline=True`` (one task per file).  The file
    position tie-break is ``monotonically_increasing_id`` within each file
    split, which follows file order inside a split.
    """
    df = spark.read.schema(RAW_EVENTS).option("multiLine", multiline).json(paths)
    df = (df.withColumn("shard_id", shard_of(F.input_file_name()))
          .withColumn("file_pos", F.monotonically_increasing_id()))
    return land_events(df)


def read_feature_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-03: the feature matrix CSV with its fixed schema."""
    return spark.read.schema(FEATURE_MATRIX).option("header", True).csv(path)


def read_predictions(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """SRC-04: per-model prediction CSVs, mapped by header name onto the fixed prediction schema.

    The files of different models carry different column subsets; columns are
    read as text (no inference) and cast to the fixed types, absent ones are NULL.
    """
    out = {}
    for m, p in paths.items():
        raw = spark.read.option("header", True).option("inferSchema", False).csv(p)
        out[m] = raw.select(*[(F.col(f.name) if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                              for f in PREDICTIONS.fields])
    return out


def read_cache(spark: SparkSession, path: str, model: str | None = None,
               statuses: tuple[str, ...] = ("success", "cached")) -> DataFrame:
    """SRC-06: cache rows of one model with a reusable status; the JSON reply flattened.

    The filters are pushed into the Parquet scan.
    """
    df = spark.read.schema(CACHE).parquet(path)
    if model is not None:
        df = df.where(F.col("model_name") == model)
    df = df.where(F.col("status").isin(*statuses))
    from trailfold.schemas import REPLY
    parsed = F.from_json("parsed_json", REPLY)
    return df.select("*", parsed["prediction"].alias("prediction"),
                     parsed["malware_probability"].alias("malware_probability"),
                     parsed["confidence"].alias("confidence"))


def read_summary_store(spark: SparkSession, path: str) -> DataFrame:
    """SRC-05: full scan of the summary store, JSON column decoded with a fixed schema."""
    from trailfold.schemas import SUMMARY_JSON
    df = spark.read.parquet(path)
    return df.withColumn("data", F.from_json("json_data", SUMMARY_JSON))


def read_templates(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SRC-07: prompt templates from files, one row per file (whole text)."""
    return (spark.read.text(paths, wholetext=True)
            .select(F.input_file_name().alias("path"), F.col("value").alias("template")))
