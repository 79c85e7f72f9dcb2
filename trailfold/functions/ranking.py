"""Exact positions inside groups without a one-task-per-group window.

``row_number() over (partition by g order by o)`` sends every row of a group
to one task.  ``position_within`` instead sorts globally by ``(g, o)`` (range
partitioning splits a hot group across tasks), numbers rows inside each
sorted partition, and adds per-(partition, group) offsets computed on a
small table of partition counts — the DataFrame form of ``zipWithIndex``.
The numbered frame is checkpointed (reliable, shared folder) so both uses
see the same partitioning even after a task retry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailfold.session import checkpoint_dir, materialize


def position_within(df: DataFrame, part: list[str], order: list, out: str = "pos") -> DataFrame:
    """Add ``out`` = 1-based position of each row in its ``part`` group by ``order`` (total order required)."""
    checkpoint_dir(df.sparkSession)
    s = materialize(df.orderBy(*part, *order)
                    .withColumn("_pid", F.spark_partition_id())
                    .withColumn("_mid", F.monotonically_increasing_id()))
    per = s.groupBy("_pid", *part).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_first"))
    w = Window.partitionBy(*part).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    j = s.join(per.select("_pid", *part, "_first", "_off"), ["_pid", *part])
    return (j.withColumn(out, (F.col("_off") + F.col("_mid") - F.col("_first") + 1).cast("long"))
            .drop("_pid", "_mid", "_first", "_off"))


def running_within(df: DataFrame, part: list[str], order: list, sums: dict, pos: str = "pos",
                   lags: dict | None = None, least: dict | None = None) -> DataFrame:
    """Exact position, inclusive running sums and previous-row values inside ``part`` groups, skew-safe.

    Same scheme as ``position_within``; the running sums are local window
    sums over ``(range partition, group)`` slices — a slice is bounded by the
    partition size even when one group holds a third of all rows — plus the
    group's totals from earlier partitions.  ``lags`` (name → column) gives
    the value of the previous row in the group: a local ``lag`` inside the
    slice, and for a slice's first row the group's last value in the nearest
    earlier partition.  ``least`` (name → column) gives the smallest value in
    the whole group, from the same small per-partition table.
    """
    checkpoint_dir(df.sparkSession)
    lags, least = lags or {}, least or {}
    small = {f"_n{i}": c for i, c in enumerate(least.values())}
    vals = {f"_v{i}": c for i, c in enumerate(sums.values())}
    lvals = {f"_l{i}": c for i, c in enumerate(lags.values())}
    s = materialize(df.withColumns({**vals, **lvals, **small}).orderBy(*part, *order)
                    .withColumn("_pid", F.spark_partition_id())
                    .withColumn("_mid", F.monotonically_increasing_id()))
    per = s.groupBy("_pid", *part).agg(
        F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_first"),
        *[F.sum(v).alias(f"_t{v}") for v in vals],
        *[F.max(F.struct(F.col("_mid"), F.col(v).alias("x")))["x"].alias(f"_z{v}") for v in lvals],
        *[F.min(v).alias(f"_k{v}") for v in small])
    s = s.drop(*small)
    w = Window.partitionBy(*part).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    wl = Window.partitionBy(*part).orderBy("_pid")
    per = per.select("_pid", *part, "_first", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"),
                     *[F.coalesce(F.sum(f"_t{v}").over(w), F.lit(0)).alias(f"_o{v}") for v in vals],
                     *[F.lag(f"_z{v}").over(wl).alias(f"_p{v}") for v in lvals],
                     *[F.min(f"_k{v}").over(Window.partitionBy(*part)).alias(n) for n, v in zip(least, small)])
    j = s.join(per, ["_pid", *part])
    local = Window.partitionBy("_pid", *part).orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    local_ord = Window.partitionBy("_pid", *part).orderBy("_mid")
    out = j.withColumn(pos, (F.col("_off") + F.col("_mid") - F.col("_first") + 1).cast("long"))
    for name, v in zip(sums, vals):
        out = out.withColumn(name, (F.col(f"_o{v}") + F.sum(v).over(local)).cast("long"))
    for name, v in zip(lags, lvals):
        out = out.withColumn(name, F.when(F.col("_mid") == F.col("_first"), F.col(f"_p{v}"))
                             .otherwise(F.lag(v).over(local_ord)))
    return out.drop("_pid", "_mid", "_first", "_off", *vals, *lvals, *[f"_o{v}" for v in vals],
                    *[f"_p{v}" for v in lvals])


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Latest row per ``key`` by ``order`` (last write wins), as one partial aggregate.

    ``max(struct(order…, row))`` is combined map-side, so even a key with a
    third of all versions never reaches one task un-reduced (no window).
    """
    rest = [c for c in df.columns if c != key]
    best = F.max(F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)],
                          F.struct(*rest).alias("_row"))).alias("_best")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"_best._row.{c}").alias(c) for c in rest])
