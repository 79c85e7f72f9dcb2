"""Score blending and the two-tier cascade (ML-08/09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: cascade thresholds ---
FAST_BENIGN, FAST_MALICIOUS = 0.05, 0.95
ENS_BENIGN, ENS_MALICIOUS = 0.35, 0.65
# --- end fixed values ---


def blend(scores: list[Column]) -> Column:
    """ML-09: mean of the available (non-null) model scores."""
    n = sum(F.when(s.isNotNull(), 1).otherwise(0) for s in scores)
    tot = sum(F.coalesce(s, F.lit(0.0)) for s in scores)
    return F.when(n > 0, tot / n)


def route(p_fast: Column, p_ens: Column) -> tuple[Column, Column]:
    """ML-08: ``(tier, decision)``.

    Tier 1 decides when the fast score is below 0.05 or above 0.95; otherwise
    the ensemble decides below 0.35 / above 0.65; the middle band (both
    bounds inclusive) goes to triage.
    """
    tier = (F.when((p_fast < FAST_BENIGN) | (p_fast > FAST_MALICIOUS), F.lit(1))
            .when((p_ens < ENS_BENIGN) | (p_ens > ENS_MALICIOUS), F.lit(2))
            .otherwise(F.lit(3)))
    decision = (F.when(p_fast < FAST_BENIGN, "benign").when(p_fast > FAST_MALICIOUS, "malicious")
                .when(p_ens < ENS_BENIGN, "benign").when(p_ens > ENS_MALICIOUS, "malicious")
                .otherwise("triage"))
    return tier, decision


def cascade(df: DataFrame, fast: str, ensemble: list[str], key: str = "experiment") -> DataFrame:
    """``key, p_fast, p_ens, tier, decision``."""
    p_ens = blend([F.col(c) for c in ensemble])
    tier, decision = route(F.col(fast), p_ens)
    return df.select(key, F.col(fast).alias("p_fast"), F.round(p_ens, 9).alias("p_ens"),
                     tier.alias("tier"), decision.alias("decision"))


def stack_lr(train: DataFrame, test: DataFrame, score_cols: list[str], label: str = "label",
             keep: list[str] | None = None, missing: float | None = None) -> DataFrame:
    """ML-09 (stacking): logistic regression over model scores, fit on ``train``.

    Returns ``keep…, p_stack`` for ``test`` — the probability of ``malicious``.
    Rows without all scores are not fitted and get no score, unless a value
    for ``missing`` ones is given.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    filled = [(F.col(c) if missing is None else F.coalesce(F.col(c), F.lit(missing))).alias(f"_{c}") for c in score_cols]
    keep = keep or ["experiment", label]
    prep = lambda d: d.select(*keep, *filled)
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=[f"_{c}" for c in score_cols], outputCol="features"),
        StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc"),
        LogisticRegression(featuresCol="features", labelCol="y", maxIter=100),
    ])
    whole = lambda d: d.dropna(subset=[f"_{c}" for c in score_cols])
    model = pipe.fit(whole(prep(train)))
    prepared = prep(test)
    scored = model.transform(whole(prepared)).select(*keep, F.round(vector_to_array("probability")[1], 9).alias("p_stack"))
    some_null = " OR ".join(f"`_{c}` IS NULL" for c in score_cols)
    return scored.unionByName(prepared.where(some_null).select(*keep, F.lit(None).cast("double").alias("p_stack")))


def stack_out_of_fold(folded: DataFrame, score_cols: list[str], k: int, keep: list[str], missing: float | None = None) -> DataFrame:
    """ML-09: every row is scored by a stacker that was fitted on the other folds (column ``fold``)."""
    out = None
    for f in range(k):
        part = stack_lr(folded.where(F.col("fold") != f), folded.where(F.col("fold") == f), score_cols, keep=keep,
                        missing=missing)
        out = part if out is None else out.unionByName(part)
    return out
