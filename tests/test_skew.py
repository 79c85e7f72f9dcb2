"""A hot key holding a third of all rows: landing, positions and running sums stay exact."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from trailfold.functions.ranking import position_within, running_within
from trailfold.operators import rates, sequence
from trailfold.schemas import FEATURES
from trailfold.sources import lens


def _events(spark, n_small=40, per_small=30):
    rng = np.random.default_rng(11)
    hot = n_small * per_small // 2                 # user 7 gets a third of all rows
    rows, eid = [], 0
    base = datetime(2024, 1, 1)
    for u in range(n_small):
        n = hot if u == 7 else per_small
        secs = np.sort(rng.choice(30 * 86400, size=n, replace=False))
        for s in secs:
            rows.append((eid, base + timedelta(seconds=int(s)), u, "view", 1.0, f'{{"k": {int(rng.integers(0, 100))}}}'))
            eid += 1
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.createDataFrame(rows, schema).repartition(6), pd.DataFrame(
        rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])


def _brute_lens(pdf):
    out = []
    for u, g in pdf.sort_values(["user_id", "ts", "event_id"]).groupby("user_id"):
        m = 0
        us0 = g["ts"].iloc[0]
        for rn, (_, r) in enumerate(g.iterrows(), 1):
            k = int(r.props.split(":")[1].strip(" }"))
            rule = "detonation" if rn == 1 else FEATURES[k % 9]
            if rule == "process_create":
                m += 1
            parent = None if rule == "detonation" else (str((m - 1) // 2) if rule == "process_create" else str(k % (m + 1)))
            out.append((str(u), rn, rule, parent, int((r.ts - us0).total_seconds() * 1e6) // 10000))
    return sorted(out, key=lambda x: (x[0], x[1]))


def test_lens_exact_with_hot_user(spark):
    ev, pdf = _events(spark)
    t = lens.trace_events(ev)
    first = t.groupBy("experiment").agg(F.min("timestamp").alias("t0"))
    got = (t.join(first, "experiment")
           .select("experiment", "ingest_seq", "RuleName", "parent_guid",
                   F.floor((F.unix_micros("timestamp") - F.unix_micros("t0"))).alias("off"))
           .collect())
    got = sorted((r.experiment, r.ingest_seq, r.RuleName, r.parent_guid, r.off) for r in got)
    assert got == _brute_lens(pdf)


def test_running_within_matches_window_on_skew(spark):
    df = spark.range(0, 6000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("g"),   # g=0 holds > 1/3
        (F.col("id") * 7919 % 100003).alias("o"), (F.col("id") % 5).alias("v"))
    got = running_within(df.repartition(5), ["g"], [F.col("o")], {"s": F.col("v")}, pos="p",
                         lags={"pv": F.col("o") * 10 + F.col("v")})
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    wo = Window.partitionBy("g").orderBy("o")
    ref = (df.withColumn("rp", F.row_number().over(wo)).withColumn("rs", F.sum("v").over(w))
           .withColumn("rl", F.lag(F.col("o") * 10 + F.col("v")).over(wo)))
    bad = got.join(ref, ["g", "o", "v"]).where((F.col("p") != F.col("rp")) | (F.col("s") != F.col("rs"))
                                               | ~F.col("pv").eqNullSafe(F.col("rl"))).count()
    assert bad == 0 and got.count() == 6000
    pw = position_within(df, ["g"], [F.col("o")])
    assert pw.join(ref, ["g", "o", "v"]).where(F.col("pos") != F.col("rp")).count() == 0


def test_hot_user_sequence_invariants(spark):
    ev, _ = _events(spark)
    t = lens.trace_events(ev)
    m = t.groupBy("experiment").agg(F.count(F.lit(1)).alias("M"))
    runs = sequence.rle_runs(t).groupBy("experiment").agg(F.sum("run_len").alias("R"), F.max("run_no").alias("N"))
    starts = sequence.run_starts(t).groupBy("experiment").agg(F.count(F.lit(1)).alias("S"))
    j = m.join(runs, "experiment").join(starts, "experiment").collect()
    assert all(r.R == r.M and r.N == r.S for r in j)
    peaks = {r.experiment: r.peak_sliding for r in rates.sliding_peak(t).collect()}
    assert peaks["7"] >= 1


def test_sliding_peak_of_a_burst(spark):
    """A third of all events in one second, ties and windows that end exactly a second later, against a search."""
    import bisect
    import random
    rng = random.Random(4)
    times = {"hot": [rng.randrange(5_000_000, 6_000_000) for _ in range(3000)] + [rng.randrange(60_000_000) for _ in range(3000)]}
    times["edge"] = [0, 0, 999_999, 1_000_000, 1_000_000, 1_999_999, 2_000_000]
    times["one"] = [7]
    for e in range(5):
        times[str(e)] = [rng.randrange(0, 4_000_000, 250_000) for _ in range(600)]
    rows = [(e, i, t) for e, ts in times.items() for i, t in enumerate(ts)]
    t = spark.createDataFrame(rows, "experiment string, ingest_seq long, offset_us long").select(
        "*", *[F.lit(None).cast("string").alias(c) for c in ("RuleName", "parent_guid", "child_guid", "child_name")])
    want = {}
    for e, ts in times.items():
        ts = sorted(ts)
        want[e] = max(bisect.bisect_right(ts, x) - bisect.bisect_right(ts, x - 1_000_000) for x in ts)
    assert want["edge"] == 3
    assert {r.experiment: r.peak_sliding for r in rates.sliding_peak(t).collect()} == want
