"""Registered model, cascade and provenance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailfold.operators import cascade, counts, features, metrics, models, provenance, sequence
from trailfold.plans import oracle as O
from trailfold.plans.catalog import register
from trailfold.plans.inputs import Inputs
from trailfold.session import materialize

KEEP = ["experiment", "year", "label"]


def _fm(i: Inputs) -> DataFrame:
    return counts.feature_matrix(i.trace, i.labels)


@register("rf_predict", None)
def _rf_predict(i: Inputs):
    """ML-01/03: forest fit on the official train split, argmax predictions for the test split."""
    fm = materialize(_fm(i))
    return models.fit_predict(fm.where(~F.col("test")), fm.where(F.col("test")), models.forest(), KEEP)


@register("rf_metrics", None)
def _rf_metrics(i: Inputs):
    """E2 headline: forest test predictions → metrics overall and per year."""
    p = materialize(_rf_predict(i))
    return metrics.metrics_by_group(p, "year", "official_test")


@register("oof_predict", None)
def _oof(i: Inputs):
    """ML-02: 10-fold out-of-fold probabilities on the train split (threshold rule)."""
    fm = _fm(i).where(~F.col("test"))
    return models.out_of_fold(fm, models.forest(), KEEP)


@register("rf_temporal", None)
def _rf_temporal(i: Inputs):
    """ML-04: retrain on non-test rows outside 2024, evaluate every 2024 row."""
    return models.temporal_retrain(_fm(i), models.forest(), KEEP)


def _all_features(i: Inputs) -> DataFrame:
    # Materialised once (reliable checkpoint): every fit below re-reads it.
    f = features.all_features(i.trace)
    return materialize(f.join(i.labels, "experiment"))


@register("gbt_predict", None)
def _gbt(i: Inputs):
    """ML-05: boosted trees on all derived features, official split."""
    f = _all_features(i)
    cols = [c for c in f.columns if c not in ("experiment", "year", "label", "test")]
    f = f.select("experiment", "year", "label", "test", *[F.col(c).cast("double").alias(c) for c in cols])
    train = f.where(~F.col("test"))
    # hundreds of rounds of a few short jobs each: a task of few rows costs more to start than to run
    few = train.coalesce(train.count() // models.ROWS_A_TASK + 1)
    return models.fit_predict(few, f.where(F.col("test")), models.boosted(cols), KEEP)


@register("ablation", None)
def _ablation(i: Inputs):
    """ML-06: baseline counts + one feature domain at a time + all; metric rows per variant."""
    f = _all_features(i)
    fam = features.DOMAIN_COLUMNS
    num = [c for c in f.columns if c not in ("experiment", "year", "label", "test")]
    f = f.select("experiment", "year", "label", "test", *[F.col(c).cast("double").alias(c) for c in num])
    out = None
    for name, pred in models.ablation(f, fam):
        m = metrics.binary_metrics(pred).select(F.lit(name).alias("variant"), *metrics.METRIC_COLUMNS)
        out = m if out is None else out.unionByName(m)
    return out


@register("seq_lr_predict", None)
def _seq_lr(i: Inputs):
    """ML-07: TF-IDF over run-length n-grams + logistic regression (official split)."""
    g = sequence.rle_ngrams(i.trace).select("experiment", "gram", "cnt")
    return models.sequence_model(g, i.labels, ~F.col("test"))


def _check_sql(where: str, by: str = "year") -> str:
    return O.q(f"""SELECT {by}, count(*) AS n, count_if(label = 'benign') AS benign, count_if(label = 'malicious') AS malicious,
       CAST(0 AS BIGINT) AS again, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS against
FROM labels_l WHERE {where} GROUP BY {by}""")


# every labelled experiment has events, so the rows to be scored follow from the labels alone
@register("rf_predict_check", _check_sql("test"))
def _rf_check(i: Inputs):
    """ML-01/03: each test experiment is scored once, within range, by the argmax rule."""
    return models.prediction_check(materialize(_rf_predict(i)), ["year"])


@register("oof_predict_check", _check_sql("NOT test"))
def _oof_check(i: Inputs):
    """ML-02: each training experiment is scored once out of fold, by the threshold rule."""
    return models.prediction_check(materialize(_oof(i)), ["year"], "threshold")


@register("rf_temporal_check", _check_sql("year = 2024"))
def _temporal_check(i: Inputs):
    """ML-04: each experiment of 2024 is scored once."""
    return models.prediction_check(materialize(_rf_temporal(i)), ["year"])


@register("gbt_predict_check", _check_sql("test"))
def _gbt_check(i: Inputs):
    """ML-05: each test experiment is scored once by the boosted trees."""
    return models.prediction_check(materialize(_gbt(i)), ["year"])


@register("seq_lr_predict_check", _check_sql("test", "test"))
def _seq_lr_check(i: Inputs):
    """ML-07: each test experiment is scored once by the sequence model."""
    return models.prediction_check(materialize(_seq_lr(i)).withColumn("test", F.lit(True)), ["test"])


@register("rf_metrics_check", O.q("""
SELECT grp AS year, count(*) AS n, count_if(label = 'benign') AS benign, count_if(label = 'malicious') AS malicious
FROM (SELECT label, unnest(['all', coalesce(CAST(year AS VARCHAR), 'unknown')]) AS grp FROM labels_l WHERE test) GROUP BY grp"""))
def _rf_metrics_check(i: Inputs):
    """The metric rows of the forest cover every test experiment, overall and per year."""
    return _rf_metrics(i).select("year", "n", "benign", "malicious")


@register("ablation_check", O.q("""
SELECT v.variant, count(*) AS n, count_if(label = 'benign') AS benign, count_if(label = 'malicious') AS malicious
FROM labels_l, (SELECT unnest(['baseline', """ + ", ".join(f"'+{d}'" for d in features.DOMAIN_COLUMNS) + """, 'full']) AS variant) v
WHERE test GROUP BY v.variant"""))
def _ablation_check(i: Inputs):
    """ML-06: every variant scores every test experiment."""
    return _ablation(i).select("variant", "n", "benign", "malicious")


def _joined_models(i: Inputs) -> DataFrame:
    rf = i.model("rf").select("experiment", F.col("malware_probability").alias("p_rf"))
    zs = i.model("zs").select("experiment", F.col("malware_probability").alias("p_zs"))
    ra = i.model("ra").select("experiment", F.col("malware_probability").alias("p_ra"))
    return rf.join(zs, "experiment").join(ra, "experiment")


_J = ",\n".join(O.model_cte(m, k) for m, k in (("rf", 7919), ("zs", 104729), ("ra", 1299709))) + """,
j AS (SELECT rf.experiment, rf.malware_probability AS p_rf, zs.malware_probability AS p_zs,
             ra.malware_probability AS p_ra
      FROM rf JOIN zs ON zs.experiment = rf.experiment JOIN ra ON ra.experiment = rf.experiment),
b AS (SELECT experiment, p_rf,
        CASE WHEN n > 0 THEN tot / n END AS pe FROM (
        SELECT *, (CASE WHEN p_rf IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN p_zs IS NOT NULL THEN 1 ELSE 0 END
                   + CASE WHEN p_ra IS NOT NULL THEN 1 ELSE 0 END) AS n,
                  (coalesce(p_rf, 0.0) + coalesce(p_zs, 0.0) + coalesce(p_ra, 0.0)) AS tot FROM j))"""


@register("blend", O.q("SELECT experiment, round(pe, 9) AS p_blend FROM b", _J))
def _blend(i: Inputs):
    """ML-09: mean blend of the available model scores."""
    j = _joined_models(i)
    return j.select("experiment", F.round(cascade.blend([F.col("p_rf"), F.col("p_zs"), F.col("p_ra")]), 9)
                    .alias("p_blend"))


@register("blend_stacked", None)
def _blend_stacked(i: Inputs):
    """ML-09 (stacking): LR on the three model scores, out of fold: every row is scored by a fit on the other folds."""
    from trailfold.operators import splits
    rf = i.model("rf").select("experiment", "label", F.col("malware_probability").alias("p_rf"))
    zs = i.model("zs").select("experiment", F.col("malware_probability").alias("p_zs"))
    ra = i.model("ra").select("experiment", F.col("malware_probability").alias("p_ra"))
    j = materialize(splits.stratified_folds(rf.join(zs, "experiment").join(ra, "experiment"), 10))
    return cascade.stack_out_of_fold(j, ["p_rf", "p_zs", "p_ra"], 10, ["experiment", "label", "fold"], missing=0.5)


@register("blend_stacked_check", O.q("""
SELECT label, count(*) AS n, CAST(0 AS BIGINT) AS again, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS against
FROM rf WHERE experiment IN (SELECT experiment FROM j) GROUP BY label""", _J))
def _blend_stacked_check(i: Inputs):
    """ML-09: every row that has the three models' scores is stacked once, out of fold."""
    p = materialize(_blend_stacked(i)).withColumnRenamed("p_stack", "malware_probability").withColumn(
        "prediction", models.threshold_decision(F.col("malware_probability")))
    return models.prediction_check(p, ["label"], "threshold").select("label", "n", "again", "outside", "against")


@register("cascade_route", O.q("""
SELECT experiment, p_rf AS p_fast, round(pe, 9) AS p_ens,
  CASE WHEN p_rf < CAST(0.05 AS DOUBLE) OR p_rf > CAST(0.95 AS DOUBLE) THEN 1
       WHEN pe < CAST(0.35 AS DOUBLE) OR pe > CAST(0.65 AS DOUBLE) THEN 2 ELSE 3 END AS tier,
  CASE WHEN p_rf < CAST(0.05 AS DOUBLE) THEN 'benign' WHEN p_rf > CAST(0.95 AS DOUBLE) THEN 'malicious'
       WHEN pe < CAST(0.35 AS DOUBLE) THEN 'benign' WHEN pe > CAST(0.65 AS DOUBLE) THEN 'malicious'
       ELSE 'triage' END AS decision
FROM b""", _J))
def _cascade(i: Inputs):
    """ML-08: fast model first, blended ensemble second, triage in the middle band."""
    return cascade.cascade(_joined_models(i), "p_rf", ["p_rf", "p_zs", "p_ra"])


@register("cascade_tiers", O.q("""
SELECT tier, decision, count(*) AS n FROM (
SELECT CASE WHEN p_rf < CAST(0.05 AS DOUBLE) OR p_rf > CAST(0.95 AS DOUBLE) THEN 1
            WHEN pe < CAST(0.35 AS DOUBLE) OR pe > CAST(0.65 AS DOUBLE) THEN 2 ELSE 3 END AS tier,
  CASE WHEN p_rf < CAST(0.05 AS DOUBLE) THEN 'benign' WHEN p_rf > CAST(0.95 AS DOUBLE) THEN 'malicious'
       WHEN pe < CAST(0.35 AS DOUBLE) THEN 'benign' WHEN pe > CAST(0.65 AS DOUBLE) THEN 'malicious'
       ELSE 'triage' END AS decision FROM b) GROUP BY tier, decision""", _J))
def _cascade_tiers(i: Inputs):
    c = cascade.cascade(_joined_models(i), "p_rf", ["p_rf", "p_zs", "p_ra"])
    return c.groupBy("tier", "decision").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ provenance
_EDGE_CASE = "CASE " + " ".join(f"WHEN RuleName = '{r}' THEN '{t}'"
                                for r, t in provenance.EDGE_DST_TYPE.items()) + " END"
_EROWS = f"""er AS (
  SELECT * FROM (
    SELECT t.experiment, t.parent_guid AS src, t.RuleName AS edge_type, {_EDGE_CASE} AS dst_type,
           CASE WHEN {_EDGE_CASE} = 'Process' THEN coalesce(t.child_guid, t.child_name) ELSE t.child_name END AS dst,
           t.t_us - f.f AS offset_us
    FROM trace t JOIN (SELECT experiment, min(t_us) AS f FROM trace GROUP BY experiment) f
      ON f.experiment = t.experiment
    WHERE t.parent_guid IS NOT NULL AND {_EDGE_CASE} IS NOT NULL)
  WHERE dst IS NOT NULL)"""


@register("prov_edges", O.q("""
SELECT experiment, 'Process' AS src_type, src, edge_type, dst_type, dst, count(*) AS n
FROM er GROUP BY experiment, src, edge_type, dst_type, dst""", _EROWS))
def _prov_edges(i: Inputs):
    """GR-01: typed provenance edges with multiplicity."""
    return provenance.prov_edges(i.trace)


_ACT_SELECT = ",\n       ".join(f"CAST(coalesce(ac.act_{r}, 0) AS BIGINT) AS act_{r}" for r in provenance.EDGE_DST_TYPE)
_ACT_AGG = ", ".join(f"count_if(edge_type = '{r}') AS act_{r}" for r in provenance.EDGE_DST_TYPE)


@register("prov_node_features", O.q(f"""
SELECT nd.experiment, nd.node_type, nd.node, nd.in_degree, nd.out_degree, dd.depth, nd.first_seen_us,
       nd.active_us,
       {_ACT_SELECT}
FROM (SELECT experiment, node_type, node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree,
             min(offset_us) AS first_seen_us, max(offset_us) - min(offset_us) AS active_us
      FROM (SELECT experiment, 'Process' AS node_type, src AS node, 0 AS i, 1 AS o, offset_us FROM er
            UNION ALL SELECT experiment, dst_type, dst, 1, 0, offset_us FROM er)
      GROUP BY experiment, node_type, node) nd
LEFT JOIN (SELECT experiment, node, CAST(min(depth) AS BIGINT) AS depth FROM walk WHERE node IS NOT NULL
           GROUP BY experiment, node) dd
  ON dd.experiment = nd.experiment AND dd.node = nd.node AND nd.node_type = 'Process'
LEFT JOIN (SELECT experiment, src AS node, {_ACT_AGG} FROM er GROUP BY experiment, src) ac
  ON ac.experiment = nd.experiment AND ac.node = nd.node AND nd.node_type = 'Process'""", _EROWS, O.TREE))
def _prov_nodes(i: Inputs):
    """GR-02: node features (degrees, BFS depth, first-seen and active span)."""
    return provenance.prov_node_features(i.trace)
