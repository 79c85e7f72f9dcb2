"""Model comparison on matched subsets (JN-03/04, PRJ-04, FLT-06, AG-20..23)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OK_STATUS = ("success", "cached")


def suffixed(pred: DataFrame, suffix: str, keys: tuple[str, ...] = ("experiment", "label")) -> DataFrame:
    """PRJ-04: rename every non-key column to ``<col>_<suffix>``."""
    return pred.withColumnsRenamed({c: f"{c}_{suffix}" for c in pred.columns if c not in keys})


def matched_join(models: dict[str, DataFrame], keys: tuple[str, ...] = ("experiment", "label"),
                 require_status: bool = True) -> DataFrame:
    """JN-03/FLT-06: inner join of several models' predictions, keeping rows valid for all.

    A row is valid for a model when its prediction is a label, its
    probability is not null and (if the model reports a status) the status
    is ``success``/``cached``.  Joins are on ``experiment, label``; each
    prediction table holds one row per experiment, so AQE picks broadcast
    or sort-merge by measured size.
    """
    out = None
    for name, df in models.items():
        v = df.where(F.col("prediction").isin("benign", "malicious") & F.col("malware_probability").isNotNull())
        if require_status and "status" in df.columns:
            v = v.where(F.col("status").isin(*OK_STATUS))
        cols = [*keys, "prediction", "malware_probability"]
        s = suffixed(v.select(*cols), name, keys)
        out = s if out is None else out.join(s, list(keys), "inner")
    return out


def disagreement(matched: DataFrame, a: str, b: str) -> DataFrame:
    """AG-20: 2×2 agreement of two models — counts and shares of n."""
    ca = F.col(f"prediction_{a}") == F.col("label")
    cb = F.col(f"prediction_{b}") == F.col("label")
    agg = matched.agg(F.count(F.lit(1)).alias("n"),
                      F.count_if(ca & cb).alias("both_correct"), F.count_if(ca & ~cb).alias(f"{a}_only"),
                      F.count_if(~ca & cb).alias(f"{b}_only"), F.count_if(~ca & ~cb).alias("both_wrong"))
    share = lambda c: F.when(F.col("n") > 0, F.round(F.col(c) / F.col("n"), 9))
    cols = ["both_correct", f"{a}_only", f"{b}_only", "both_wrong"]
    return agg.select("n", *cols, *[share(c).alias(f"{c}_share") for c in cols])


def exclusive_detections(matched: DataFrame, a: str, b: str) -> DataFrame:
    """AG-21: on malicious rows — detections per model and exclusive detections each way."""
    m = matched.where(F.col("label") == "malicious")
    da = F.col(f"prediction_{a}") == "malicious"
    db = F.col(f"prediction_{b}") == "malicious"
    return m.agg(F.count(F.lit(1)).alias("malicious"),
                 F.count_if(da).alias(f"detected_{a}"), F.count_if(db).alias(f"detected_{b}"),
                 F.count_if(da & ~db).alias(f"{a}_not_{b}"), F.count_if(db & ~da).alias(f"{b}_not_{a}"))


def union_ensemble(matched: DataFrame, a: str, b: str) -> DataFrame:
    """AG-22: recall of "either model flags" on malicious rows."""
    m = matched.where(F.col("label") == "malicious")
    either = (F.col(f"prediction_{a}") == "malicious") | (F.col(f"prediction_{b}") == "malicious")
    return m.agg(F.count(F.lit(1)).alias("malicious"), F.count_if(either).alias("detected_either"),
                 F.round(F.avg(either.cast("double")), 9).alias("union_recall"))


def split_year_counts(labels: DataFrame) -> DataFrame:
    """AG-23: ``split, year, benign, malicious`` (pivot with explicit values)."""
    split = F.when(F.col("test"), "test").otherwise("train")
    return (labels.groupBy(split.alias("split"), "year")
            .agg(F.count_if(F.col("label") == "benign").alias("benign"),
                 F.count_if(F.col("label") == "malicious").alias("malicious")))


def comparison_table(models: dict[str, DataFrame], scopes: dict[str, DataFrame], undefined: str = "zero") -> DataFrame:
    """``scope, model, expected, coverage, …metrics`` for every model in every scope.

    ``scopes`` name sets of experiments (one column ``experiment``, one row
    each).  Within a scope all models are judged on the same rows, those that
    every model answered validly; coverage is their share of the scope.  The
    models stand one below the other as rows, so that one grouped pass gives all
    confusion counts, ratios and AUCs.
    """
    from trailfold.operators.metrics import METRIC_COLUMNS, binary_metrics
    ids = None
    for name, rows in scopes.items():
        part = rows.select("experiment", F.lit(name).alias("scope"))
        ids = part if ids is None else ids.unionByName(part)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"prediction_{m}").alias("prediction"),
                                        F.col(f"malware_probability_{m}").alias("malware_probability")) for m in models]))
    long = (matched_join(models).join(ids, "experiment").select("scope", "label", each.alias("m"))
            .select("scope", "label", "m.model", "m.prediction", "m.malware_probability"))
    table = binary_metrics(long, ["scope", "model"], undefined=undefined)
    # per scope and model, so that the join has a key that no single scope makes constant
    names = F.explode(F.array(*[F.lit(m) for m in models]))
    expected = ids.select("scope", names.alias("model")).groupBy("scope", "model").agg(F.count(F.lit(1)).alias("expected"))
    return (table.join(expected, ["scope", "model"])
            .select("scope", "model", "expected", F.round(F.col("n") / F.col("expected"), 4).alias("coverage"), *METRIC_COLUMNS))


def run_report(audit: DataFrame, labels: DataFrame, undefined: str = "zero") -> DataFrame:
    """One row per configuration of a scoring run: expected rows, failures, coverage, metrics and usage means.

    ``audit`` holds one row per expected experiment; failures are those
    without a valid prediction, and are counted, never taken as benign.
    """
    from trailfold.operators.metrics import METRIC_COLUMNS, binary_metrics, valid_mask
    key = ["config", "model"]
    rows = audit.join(labels.select(F.col("experiment").alias("experiment_id"), "label"), "experiment_id")
    ok = F.coalesce(valid_mask(rows), F.lit(False)) & F.col("status").isin(*OK_STATUS)
    totals = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("expected"), F.count_if(ok).alias("valid_predictions"),
        F.round(F.avg(F.coalesce("latency_sec", F.lit(0.0))), 3).alias("avg_latency_sec"),
        F.round(F.avg(F.coalesce(F.col("prompt_tokens").cast("double"), F.lit(0.0))), 1).alias("avg_prompt_tokens"),
        F.round(F.avg(F.coalesce(F.col("completion_tokens").cast("double"), F.lit(0.0))), 1).alias("avg_completion_tokens"))
    table = binary_metrics(rows.where(ok), key, undefined=undefined)
    return (totals.join(table, key, "left")
            .select(*key, "expected", "valid_predictions", (F.col("expected") - F.col("valid_predictions")).alias("failures"),
                    F.round(F.col("valid_predictions") / F.col("expected"), 4).alias("coverage"),
                    *[c for c in METRIC_COLUMNS if c not in ("expected",)],
                    "avg_latency_sec", "avg_prompt_tokens", "avg_completion_tokens"))
