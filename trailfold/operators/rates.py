"""Trace timing: duration, average rate, tumbling and sliding 1 s peaks.

Time offsets are always relative to the experiment's first event
(PRJ-10): calendar time never leaves this module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailfold.functions.ranking import running_within
from trailfold.operators.folds import by_experiment

US = 1_000_000


def trace_bounds(trace: DataFrame) -> DataFrame:
    """AG-04: ``experiment, total_events, first_us, last_us, duration_seconds``.

    min/max/count are partially aggregated before the shuffle, so a hot
    experiment costs one row per scan task.
    """
    b = by_experiment(trace).select("experiment", "total_events", "first_us", "last_us")
    return b.withColumn(
        "duration_seconds",
        F.greatest(F.lit(0.0), (F.col("last_us") - F.col("first_us")) / F.lit(float(US))))


def relative_offsets(trace: DataFrame) -> DataFrame:
    """PRJ-10: every event with its offset from the experiment start, no calendar time.

    The landed table carries the offset: a projection, no shuffle.
    """
    return trace.select("experiment", "ingest_seq", "RuleName", "parent_guid", "child_guid", "child_name", "offset_us")


def tumbling_peak(trace: DataFrame) -> DataFrame:
    """AG-06: max events in one 1 s bin anchored at the first event."""
    off = relative_offsets(trace)
    bins = off.groupBy("experiment", F.floor(F.col("offset_us") / US).alias("sec")).agg(
        F.count(F.lit(1)).alias("n"))
    return bins.groupBy("experiment").agg(F.max("n").alias("peak_bin"))


def trace_rates(trace: DataFrame) -> DataFrame:
    """AG-04/05/06: duration (3 digits), average rate (2 digits, half-even) and 1 s peak.

    Zero duration: average = peak = number of events.
    """
    b = trace_bounds(trace)
    p = tumbling_peak(trace)
    dur = F.col("duration_seconds")
    n = F.col("total_events")
    return (b.join(p, "experiment")
            .select(
                "experiment", "total_events",
                F.bround(dur, 3).alias("duration_seconds"),
                F.when(dur > 0, F.bround(n / F.greatest(F.lit(1.0), dur), 2))
                 .otherwise(n.cast("double")).alias("avg_events_per_sec"),
                F.when(dur > 0, F.col("peak_bin")).otherwise(n).cast("long").alias("peak_events_per_sec")))


def sliding_peak(trace: DataFrame) -> DataFrame:
    """WN-09: max events in any sliding 1 s window ``(t - 1 s, t]``.

    A sweep over the instants: an event counts from its time on and no longer
    one second later, so the window of ``t`` holds the sum of all changes up
    to ``t``.  Changes at one instant are added up before they are sorted, and
    the running sums come from ``running_within``: neither a burst in one
    second nor a hot experiment is one task's work.
    """
    instants = relative_offsets(trace).groupBy("experiment", F.col("offset_us").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    changes = (instants.select("experiment", F.explode(F.array(
                   F.struct("t", F.col("n").alias("change")),
                   F.struct((F.col("t") + US).alias("t"), (-F.col("n")).alias("change")))).alias("c"))
               .groupBy("experiment", F.col("c.t").alias("t")).agg(F.sum("c.change").alias("change")))
    live = running_within(changes, ["experiment"], [F.col("t")], {"live": F.col("change")})
    return live.groupBy("experiment").agg(F.max("live").cast("long").alias("peak_sliding"))
