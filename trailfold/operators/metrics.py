"""Classification metrics as aggregates (AG-12..19), overall and per group.

* Confusion counts are four ``count_if`` in one partial aggregate.
* ROC AUC / standardised partial AUC are exact (ties handled as sklearn
  does) and distributed: scores are first reduced to one row per
  (group, distinct score); the "how many negatives/positives rank below"
  prefix sums are computed in two levels — across fixed-width score bins
  (a small table) and inside each (group, bin) — so no single task ever
  sorts a whole group.
* Two policies for undefined ratios: ``'null'`` (the per-year evaluation)
  and ``'zero'`` (the model comparisons).  AUCs are NULL unless both classes
  are present, under both policies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_FPR = 0.1
SCORE_BINS = 4096
DIGITS = 9

METRIC_COLUMNS = ["n", "benign", "malicious", "tn", "fp", "fn", "tp", "accuracy", "malware_recall",
                  "malware_precision", "malware_f1", "benign_fpr", "balanced_accuracy", "roc_auc",
                  "partial_auc_max_fpr_0_1"]


def _is_mal(c: str) -> Column:
    return F.col(c) == "malicious"


def confusion(df: DataFrame, group: list[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """AG-12: ``group…, n, benign, malicious, tn, fp, fn, tp``."""
    y, p = _is_mal(label), _is_mal(prediction)
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~y).alias("benign"), F.count_if(y).alias("malicious"),
        F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"))


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys`` where a null key matches a null key; the keys come from ``a``."""
    renamed = b.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, [a[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return a.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def roc_points(df: DataFrame, group: list[str], label: str = "label", score: str = "malware_probability",
               bins: int = SCORE_BINS) -> DataFrame:
    """One row per (group, distinct score): ``pos, neg, pos_below, neg_below``."""
    y = _is_mal(label)
    per = df.groupBy(*group, F.col(score).alias("s")).agg(
        F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    per = per.where(F.col("s").isNotNull()).withColumn("bin", F.floor(F.col("s") * bins))
    bin_tot = per.groupBy(*group, "bin").agg(F.sum("pos").alias("bpos"), F.sum("neg").alias("bneg"))
    wb = Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    wg = Window.partitionBy(*group)
    # group totals come from the small bin table and ride along the keyed (group, bin) join
    bin_tot = (bin_tot.withColumn("pos_before_bin", F.coalesce(F.sum("bpos").over(wb), F.lit(0)))
               .withColumn("neg_before_bin", F.coalesce(F.sum("bneg").over(wb), F.lit(0)))
               .withColumn("P", F.sum("bpos").over(wg)).withColumn("N", F.sum("bneg").over(wg)))
    wi = Window.partitionBy(*group, "bin").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    per = (per.withColumn("pos_in", F.coalesce(F.sum("pos").over(wi), F.lit(0)))
           .withColumn("neg_in", F.coalesce(F.sum("neg").over(wi), F.lit(0))))
    j = _null_safe(per, bin_tot.select(*group, "bin", "pos_before_bin", "neg_before_bin", "P", "N"), [*group, "bin"], "inner")
    return j.select(*group, "s", "pos", "neg",
                    (F.col("pos_before_bin") + F.col("pos_in")).alias("pos_below"),
                    (F.col("neg_before_bin") + F.col("neg_in")).alias("neg_below"), "P", "N")


def auc_table(df: DataFrame, group: list[str], label: str = "label", score: str = "malware_probability",
              max_fpr: float = MAX_FPR) -> DataFrame:
    """``group…, roc_auc, partial_auc_max_fpr_0_1`` (NULL unless both classes present).

    ROC segments run from the point above a distinct score ``s`` to the point
    at ``s`` (scores descending): ``x0 = neg_above/N``, ``x1 = (neg_above+neg)/N``
    and likewise for TPR.  The partial area clips segments at ``max_fpr`` by
    linear interpolation, then is standardised (McClish).
    """
    j = roc_points(df, group, label, score)
    P, N = F.col("P").cast("double"), F.col("N").cast("double")
    # try_divide: a one-class group has P or N = 0 (its AUC is NULL below).
    x1 = F.try_divide(F.col("N") - F.col("neg_below"), N)
    x0 = F.try_divide(F.col("N") - F.col("neg_below") - F.col("neg"), N)
    y1 = F.try_divide(F.col("P") - F.col("pos_below"), P)
    y0 = F.try_divide(F.col("P") - F.col("pos_below") - F.col("pos"), P)
    full = (x1 - x0) * (y0 + y1) / 2
    ym = y0 + F.try_divide((y1 - y0) * (F.lit(max_fpr) - x0), x1 - x0)
    part = (F.when(x1 <= max_fpr, full)
            .when(x0 < max_fpr, (F.lit(max_fpr) - x0) * (y0 + ym) / 2)
            .otherwise(F.lit(0.0)))
    agg = j.groupBy(*group).agg(F.sum(full).alias("area"), F.sum(part).alias("parea"),
                                F.first("P").alias("P"), F.first("N").alias("N"))
    both = (F.col("P") > 0) & (F.col("N") > 0)
    min_area, max_area = 0.5 * max_fpr ** 2, max_fpr
    std = 0.5 * (1 + (F.col("parea") - min_area) / (max_area - min_area))
    return agg.select(*group,
                      F.when(both, F.round(F.col("area"), DIGITS)).alias("roc_auc"),
                      F.when(both, F.round(std, DIGITS)).alias("partial_auc_max_fpr_0_1"))


def _ratios(undefined: str) -> list[Column]:
    c = lambda n: F.col(n).cast("double")
    tn, fp, fn, tp, n = c("tn"), c("fp"), c("fn"), c("tp"), c("n")
    z = F.lit(0.0) if undefined == "zero" else F.lit(None).cast("double")
    rd = lambda x: F.round(x, DIGITS)
    both = (tp + fn > 0) & (tn + fp > 0)
    recall = tp / (tp + fn)
    prec = tp / (tp + fp)
    if undefined == "zero":
        f1 = F.when(tp > 0, 2 * prec * recall / (prec + recall)).otherwise(z)
    else:
        f1 = F.when(tp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(z)
    return [
        F.when(n > 0, rd((tp + tn) / n)).otherwise(z).alias("accuracy"),
        F.when(tp + fn > 0, rd(recall)).otherwise(z).alias("malware_recall"),
        F.when(tp + fp > 0, rd(prec)).otherwise(z).alias("malware_precision"),
        rd(f1).alias("malware_f1"),
        F.when(tn + fp > 0, rd(fp / (tn + fp))).otherwise(z).alias("benign_fpr"),
        F.when(both, rd((tp / (tp + fn) + tn / (tn + fp)) / 2)).otherwise(z).alias("balanced_accuracy"),
    ]


def binary_metrics(df: DataFrame, group: list[str] | None = None, label: str = "label",
                   prediction: str = "prediction", score: str = "malware_probability",
                   undefined: str = "null") -> DataFrame:
    """UD-05: one row per group with confusion counts, ratios and AUCs.

    ``df`` is the set of *valid* predictions (see ``valid_mask``).  Without
    ``group`` the result is exactly one row, also for an empty input (n = 0,
    ratios NULL or 0 by policy, AUCs NULL).
    """
    if group:
        cm = confusion(df, group, label, prediction)
        auc = auc_table(df, group, label, score)
        j = _null_safe(cm, auc, group, "left")
    else:
        # The global confusion row (one row even when empty) and the (0 or 1)
        # AUC row are combined by a union and a global aggregate — no join.
        cm = confusion(df, [], label, prediction)
        auc = auc_table(df, [], label, score)
        cm_cols, auc_cols = cm.columns, ["roc_auc", "partial_auc_max_fpr_0_1"]
        u = (cm.select(*cm_cols, *[F.lit(None).cast("double").alias(c) for c in auc_cols])
             .unionByName(auc.select(*[F.lit(None).cast("long").alias(c) for c in cm_cols], *auc_cols)))
        j = u.agg(*[F.max(c).alias(c) for c in cm_cols + auc_cols])
        group = []
    return j.select(*group, "n", "benign", "malicious", "tn", "fp", "fn", "tp", *_ratios(undefined),
                    "roc_auc", "partial_auc_max_fpr_0_1")


def with_groups(df: DataFrame, by: str, total: str = "all", null_name: str = "unknown") -> DataFrame:
    """AG-14 + PRJ-07: each row once in its ``by`` group and once in the total.

    Equivalent to ``GROUPING SETS ((by), ())``: an Expand of two rows per
    input row, ahead of the partial aggregation.  The null group is named
    ``unknown``; the total is ``all``.
    """
    g = F.coalesce(F.col(by).cast("long").cast("string"), F.lit(null_name))
    return df.withColumn("grp", F.explode(F.array(F.lit(total), g)))


def metrics_by_group(df: DataFrame, by: str, evaluation: str, undefined: str = "null", **kw) -> DataFrame:
    """``evaluation, <by>, …metrics`` — the overall row plus one row per value of ``by``."""
    m = binary_metrics(with_groups(df, by), ["grp"], undefined=undefined, **kw)
    # ST-03: the overall row first, then groups in numeric order, the null group last
    order = [F.when(F.col("grp") == "all", 0).when(F.col("grp") == "unknown", 2).otherwise(1),
             F.col("grp").try_cast("long").asc_nulls_last()]
    return m.orderBy(*order).select(F.lit(evaluation).alias("evaluation"), F.col("grp").alias(by),
                                    *METRIC_COLUMNS)


def valid_mask(df: DataFrame, prediction: str = "prediction", score: str = "malware_probability") -> Column:
    """FLT-05: prediction in the label domain and a non-null probability."""
    return F.col(prediction).isin("benign", "malicious") & F.col(score).isNotNull()


def coverage(df: DataFrame, expected: int | None = None, prediction: str = "prediction",
             score: str = "malware_probability") -> DataFrame:
    """AG-17: ``n, valid_predictions, failures, coverage`` against the expected total."""
    a = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(valid_mask(df, prediction, score)).alias("valid"))
    n = F.lit(expected) if expected is not None else F.col("rows")
    return a.select(n.cast("long").alias("n"), F.col("valid").cast("long").alias("valid_predictions"),
                    (n - F.col("valid")).cast("long").alias("failures"),
                    F.when(n > 0, F.round(F.col("valid") / n, 4)).otherwise(F.lit(0.0)).alias("coverage"))


def usage_means(df: DataFrame) -> DataFrame:
    """AG-18: mean latency / tokens over **all** rows, missing values as 0."""
    return df.agg(
        F.round(F.avg(F.coalesce(F.col("latency_sec"), F.lit(0.0))), 3).alias("avg_latency_sec"),
        F.round(F.avg(F.coalesce(F.col("prompt_tokens").cast("double"), F.lit(0.0))), 1).alias("avg_prompt_tokens"),
        F.round(F.avg(F.coalesce(F.col("completion_tokens").cast("double"), F.lit(0.0))), 1)
        .alias("avg_completion_tokens"))


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """AG-19."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
