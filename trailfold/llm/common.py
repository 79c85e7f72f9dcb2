"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from trailfold.session import checkpoint_dir


ROWS_AT_ONCE = 2000


def few_rows(spark: SparkSession) -> None:
    """The session hands at most ``ROWS_AT_ONCE`` rows to Python at once (a setting of fewer stays).

    Texts have some KB each and some have many more: Spark's 10,000 rows are
    tens of MB, several times over, in the JVM and in every Python worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_AT_ONCE:
        spark.conf.set(key, str(ROWS_AT_ONCE))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark from any path that Spark knows."""
    few_rows(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_RECORDED: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that are ``saved`` inside, for ``remove`` when nothing reads them any more."""
    paths: list[str] = []
    _RECORDED.append(paths)
    try:
        yield paths
    finally:
        _RECORDED.remove(paths)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete saved tables, and let Spark drop the shuffle files of plans that are gone."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    paths.clear()
    gc.collect()
    jvm.System.gc()


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read back.

    Cuts the lineage like ``checkpoint()`` but runs the plan once, and the
    table that is read back is a plain scan: columns prune, and joins on it
    have an exchange of their own that AQE can split.
    """
    spark = df.sparkSession
    few_rows(spark)
    path = f"{checkpoint_dir(spark).rstrip('/')}/saved-{uuid.uuid4().hex}"
    for paths in _RECORDED:
        paths.append(path)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside hand at most so many rows to Python at once, for rows of some KB each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores until no column is called so (names ignore case)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def shuffle_width(spark: SparkSession) -> int:
    """Partition count for an explicit repartition: the session's own setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that ``column`` holds about ``limit`` bytes per slice (a longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column in UTF-8, or of a binary one, and the ``n + 1`` offsets of its rows (null: empty)."""
    if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type):
        array = array.cast(pa.large_binary()).fill_null(b"")
    else:
        array = array.cast(pa.large_string()).fill_null("")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset:array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]
