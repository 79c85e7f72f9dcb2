"""Event sequences: run-length encoding, bigrams, Markov probabilities, entropy, n-grams.

``ingest_seq`` is the dense chronological position of an event inside its
experiment and ``prev_rule`` its predecessor's rule, both set once at
landing (skew-safe), so bigrams and run boundaries are plain projections
and filters — no shuffle.  Tables without ``prev_rule`` fall back to an
equi-join on ``(experiment, ingest_seq - 1)``, never to a ``lag`` window
over a whole experiment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailfold.operators.folds import by_experiment

MAX_RUNS_SHOWN = 40
BLOCK = 4096   # positions of an experiment that one task sorts at once


def with_previous(trace: DataFrame) -> DataFrame:
    """``experiment, ingest_seq, rule, prev_rule`` (``prev_rule`` null for the first event).

    A landed table carries ``prev_rule`` already (no shuffle); otherwise the
    predecessor is found by the equi-join on ``(experiment, ingest_seq - 1)``.
    """
    if "prev_rule" in trace.columns:
        return trace.select("experiment", "ingest_seq", F.col("RuleName").alias("rule"), "prev_rule")
    cur = trace.select("experiment", "ingest_seq", F.col("RuleName").alias("rule"))
    prev = trace.select("experiment", (F.col("ingest_seq") + 1).alias("ingest_seq"),
                        F.col("RuleName").alias("prev_rule"))
    return cur.join(prev, ["experiment", "ingest_seq"], "left")


def bigram_rows(trace: DataFrame) -> DataFrame:
    """WN-06 rows: ``experiment, ingest_seq, a, b`` for each consecutive pair (M-1 per experiment)."""
    if "prev_rule" in trace.columns:
        return (trace.where(F.col("prev_rule").isNotNull())
                .select("experiment", "ingest_seq", F.col("prev_rule").alias("a"), F.col("RuleName").alias("b")))
    cur = trace.select("experiment", "ingest_seq", F.col("RuleName").alias("b"))
    prev = trace.select("experiment", (F.col("ingest_seq") + 1).alias("ingest_seq"), F.col("RuleName").alias("a"))
    return prev.join(cur, ["experiment", "ingest_seq"])


def bigrams(trace: DataFrame) -> DataFrame:
    """WN-06: ``experiment, a, b, n``."""
    return bigram_rows(trace).groupBy("experiment", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def markov_probs(trace: DataFrame) -> DataFrame:
    """WN-07: ``experiment, a, b, n, p`` with p = n / transitions out of a (rounded 9)."""
    bg = bigrams(trace)
    out = bg.groupBy("experiment", "a").agg(F.sum("n").alias("n_a"))
    return (bg.join(out, ["experiment", "a"])
            .select("experiment", "a", "b", "n", F.round(F.col("n") / F.col("n_a"), 9).alias("p")))


def transition_stats(trace: DataFrame) -> DataFrame:
    """WN-08: ``experiment, transitions, unique_transition_types, transition_entropy`` (bits, 6 digits)."""
    bg = bigrams(trace)
    tot = bg.groupBy("experiment").agg(F.sum("n").alias("tot"))
    j = bg.join(tot, "experiment").withColumn("p", F.col("n") / F.col("tot"))
    return j.groupBy("experiment").agg(
        F.first("tot").cast("long").alias("transitions"),
        F.count(F.lit(1)).cast("long").alias("unique_transition_types"),
        F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("transition_entropy"))


def run_starts(trace: DataFrame) -> DataFrame:
    """Positions where a new run begins: ``experiment, ingest_seq, rule``."""
    p = with_previous(trace)
    return (p.where(F.col("prev_rule").isNull() | (F.col("prev_rule") != F.col("rule")))
            .select("experiment", "ingest_seq", "rule"))


def rle_runs(trace: DataFrame) -> DataFrame:
    """WN-02: ``experiment, run_no, rule, run_len`` — every run, in order.

    The starts are numbered inside blocks of ``BLOCK`` positions, of which a hot
    experiment has many, so that its starts are numbered by many tasks; what
    lies before a block, and the start after it, come from a small table of
    blocks.  A run's length is the distance to the next start; the last run
    ends at the experiment's last event.  The events are shuffled once.
    """
    block = ["experiment", "block"]
    starts = run_starts(trace).withColumn("block", F.floor(F.col("ingest_seq") / BLOCK))
    per = starts.groupBy(*block).agg(F.count(F.lit(1)).alias("starts"), F.min("ingest_seq").alias("first_seq"))
    by_block = Window.partitionBy("experiment").orderBy("block")
    per = (per.withColumn("before", F.coalesce(F.sum("starts").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
           .withColumn("after", F.lead("first_seq").over(by_block)))
    total = by_experiment(trace).select("experiment", (F.col("last_seq") + 1).alias("end"))
    per = per.join(total, "experiment").select(*block, "before", F.coalesce("after", "end").alias("after"))
    inside = Window.partitionBy(*block).orderBy("ingest_seq")
    r = (starts.withColumn("nth", F.row_number().over(inside)).withColumn("next_seq", F.lead("ingest_seq").over(inside))
         .join(per, block))
    return r.select("experiment", (F.col("before") + F.col("nth")).cast("long").alias("run_no"), "rule",
                    (F.coalesce("next_seq", "after") - F.col("ingest_seq")).cast("long").alias("run_len"))


def _render(rule, n):
    return F.when(n > 1, F.concat(rule, F.lit(" x"), n.cast("string"))).otherwise(rule)


def rle_display(trace: DataFrame, max_runs: int = MAX_RUNS_SHOWN) -> DataFrame:
    """WN-03: ``experiment, n_runs, runs`` — first ``max_runs`` rendered runs (+ omission marker).

    Only the first ``max_runs + 1`` run starts per experiment are ranked (a
    window group limit: each task keeps at most that many per experiment);
    the total run count is a plain partial count.  ``runs`` is an
    ``ARRAY<STRING>`` in order.
    """
    starts = run_starts(trace)
    n_runs = starts.groupBy("experiment").agg(F.count(F.lit(1)).alias("n_runs"))
    last = by_experiment(trace).select("experiment", "last_seq")
    w = Window.partitionBy("experiment").orderBy("ingest_seq")
    head = starts.withColumn("run_no", F.row_number().over(w)).where(F.col("run_no") <= max_runs + 1)
    w2 = Window.partitionBy("experiment").orderBy("run_no")
    head = (head.withColumn("next_seq", F.lead("ingest_seq").over(w2)).where(F.col("run_no") <= max_runs)
            .join(last, "experiment")
            .withColumn("len", F.coalesce(F.col("next_seq"), F.col("last_seq") + 1) - F.col("ingest_seq")))
    arr = head.groupBy("experiment").agg(
        F.array_sort(F.collect_list(F.struct("run_no", _render(F.col("rule"), F.col("len")).alias("txt"))))
        .alias("r"))
    j = arr.join(n_runs, "experiment")
    runs = F.transform("r", lambda s: s["txt"])
    marker = F.concat(F.lit("... ["), (F.col("n_runs") - max_runs).cast("string"),
                      F.lit(" further event runs omitted]"))
    return j.select("experiment", F.col("n_runs").cast("long").alias("n_runs"),
                    F.when(F.col("n_runs") > max_runs, F.concat(runs, F.array(marker))).otherwise(runs)
                    .alias("runs"))


def rle_text(trace: DataFrame) -> DataFrame:
    """WN-03 rendered: ``experiment, n_runs, flow`` joined with ``' -> '``."""
    d = rle_display(trace)
    return d.select("experiment", "n_runs", F.array_join("runs", " -> ").alias("flow"))


def rle_ngrams(trace: DataFrame, n_min: int = 2, n_max: int = 4) -> DataFrame:
    """WN-12: n-grams (n = 2..4) over the run-length rule sequence.

    ``experiment, n, gram, cnt`` with grams joined by ``' '``.  Runs are put
    into blocks of ``BLOCK`` runs of an experiment, those that begin a block
    also at the end of the block before, so that a gram lies in one block and no
    task sorts an experiment: the runs are shuffled once, whatever ``n_max``.
    """
    runs = rle_runs(trace).select("experiment", "run_no", "rule")
    block, into = F.floor((F.col("run_no") - 1) / BLOCK), (F.col("run_no") - 1) % BLOCK
    again = F.when((into < n_max - 1) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    runs = runs.withColumn("block", F.explode(again))
    w = Window.partitionBy("experiment", "block").orderBy("run_no")
    runs = runs.withColumns({f"r{j}": F.lead(F.struct("run_no", "rule"), j).over(w) for j in range(1, n_max)})
    # a run that was put there from the next block begins no gram here
    runs = runs.where(F.floor((F.col("run_no") - 1) / BLOCK) == F.col("block"))
    gram = lambda n: F.concat_ws(" ", "rule", *[f"r{j}.rule" for j in range(1, n)])
    grams = F.array(*[F.when(F.col(f"r{n - 1}").isNotNull(), F.struct(F.lit(n).alias("n"), gram(n).alias("gram")))
                      for n in range(n_min, n_max + 1)])
    out = (runs.select("experiment", F.explode(grams).alias("g")).where(F.col("g").isNotNull())
           .groupBy("experiment", "g.n", "g.gram").agg(F.count(F.lit(1)).alias("cnt")))
    return out.select("experiment", F.col("n").cast("int").alias("n"), "gram", F.col("cnt").cast("long").alias("cnt"))
