"""Registered evaluation queries: metrics, comparisons, splits, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailfold.operators import checks, compare, counts, metrics, splits
from trailfold.plans import oracle as O
from trailfold.plans.catalog import register
from trailfold.plans.inputs import Inputs
from trailfold.schemas import FEATURES

M_COLS = ", ".join(metrics.METRIC_COLUMNS)


# ------------------------------------------------------------------ metrics
@register("confusion_matrix", O.q("""
SELECT count(*) AS n, count_if(label <> 'malicious') AS benign, count_if(label = 'malicious') AS malicious,
       count_if(label <> 'malicious' AND prediction <> 'malicious') AS tn,
       count_if(label <> 'malicious' AND prediction = 'malicious') AS fp,
       count_if(label = 'malicious' AND prediction <> 'malicious') AS fn,
       count_if(label = 'malicious' AND prediction = 'malicious') AS tp
FROM scores_l"""))
def _confusion(i: Inputs):
    return metrics.confusion(i.scores, [])


_c, _cols = O.metrics_sql("scores_l", False, score="score")


@register("binary_metrics", O.q(f"SELECT {_cols} FROM met", _c))
def _binary_metrics(i: Inputs):
    """AG-13 with the NULL policy on the score lens."""
    return metrics.binary_metrics(i.scores, score="score")


@register("roc_auc", O.q("SELECT roc_auc, partial_auc_max_fpr_0_1 FROM auc", _c))
def _roc_auc(i: Inputs):
    """AG-15/16 on the score lens (ties in scores)."""
    return metrics.auc_table(i.scores, [], score="score")


_cz, _ = O.metrics_sql("rav", False, undefined="zero")
_RA_VALID = ("rav AS (SELECT * FROM ra WHERE prediction IN ('benign', 'malicious') "
             "AND malware_probability IS NOT NULL)")


@register("binary_metrics_zero", O.q(f"SELECT {_cols} FROM met", O.model_cte("ra", 1299709), _RA_VALID, _cz))
def _binary_metrics_zero(i: Inputs):
    """AG-13 with the 0.0 policy on the valid rows of one model."""
    ra = i.model("ra")
    return metrics.binary_metrics(ra.where(metrics.valid_mask(ra)), undefined="zero")


_cy, _ = O.metrics_sql("lp_l", True)


@register("metrics_by_year", O.q(f"SELECT 'official' AS evaluation, grp AS year, {_cols} FROM met", _cy))
def _metrics_by_year(i: Inputs):
    """AG-14: overall + per year (null year → 'unknown'), NULL policy."""
    return metrics.metrics_by_group(i.label_predictions, "year", "official")


@register("partial_auc", O.q("SELECT grp AS year, roc_auc, partial_auc_max_fpr_0_1 FROM auc", _cy))
def _partial_auc(i: Inputs):
    g = metrics.with_groups(i.label_predictions, "year")
    return metrics.auc_table(g, ["grp"]).withColumnRenamed("grp", "year")


@register("coverage", O.q("""
SELECT CAST(count(*) AS BIGINT) AS n,
       CAST(count_if(prediction IN ('benign', 'malicious') AND malware_probability IS NOT NULL) AS BIGINT)
         AS valid_predictions,
       CAST(count(*) - count_if(prediction IN ('benign', 'malicious') AND malware_probability IS NOT NULL)
         AS BIGINT) AS failures,
       CASE WHEN count(*) > 0 THEN round(count_if(prediction IN ('benign', 'malicious')
         AND malware_probability IS NOT NULL) / count(*), 4) ELSE 0.0 END AS coverage
FROM ra""", O.model_cte("ra", 1299709)))
def _coverage(i: Inputs):
    return metrics.coverage(i.model("ra"))


@register("valid_mask", O.q("""
SELECT experiment, coalesce(prediction IN ('benign', 'malicious') AND malware_probability IS NOT NULL, false)
  AS valid FROM ra""", O.model_cte("ra", 1299709)))
def _valid_mask(i: Inputs):
    ra = i.model("ra")
    return ra.select("experiment", F.coalesce(metrics.valid_mask(ra), F.lit(False)).alias("valid"))


@register("threshold_decision", O.q("""
SELECT doc_id, score, CASE WHEN score >= 0.5 THEN 'malicious' ELSE 'benign' END AS decision FROM scores_l"""))
def _threshold(i: Inputs):
    """PRJ-05: ``p >= t`` → malicious."""
    from trailfold.operators.models import threshold_decision
    return i.scores.select("doc_id", "score", threshold_decision(F.col("score")).alias("decision"))


@register("class_counts", O.q("SELECT label, count(*) AS n FROM labels_l GROUP BY label"))
def _class_counts(i: Inputs):
    return metrics.class_counts(i.labels)


@register("split_year_counts", O.q("""
SELECT CASE WHEN test THEN 'test' ELSE 'train' END AS split, year,
       count_if(label = 'benign') AS benign, count_if(label = 'malicious') AS malicious
FROM labels_l GROUP BY split, year"""))
def _split_year_counts(i: Inputs):
    return compare.split_year_counts(i.labels)


# ---------------------------------------------------------------- compare
def _models(i: Inputs):
    return {m: i.model(m) for m in ("rf", "zs", "ra")}


_MODELS = [O.model_cte(m, k) for m, k in (("rf", 7919), ("zs", 104729), ("ra", 1299709))]


def _valid(m: str) -> str:
    return (f"{m}v AS (SELECT experiment, label, prediction AS prediction_{m}, "
            f"malware_probability AS malware_probability_{m} FROM {m} "
            f"WHERE prediction IN ('benign', 'malicious') AND malware_probability IS NOT NULL "
            f"AND status IN ('success', 'cached'))")


_MATCHED = ",\n".join(_MODELS + [_valid(m) for m in ("rf", "zs", "ra")]) + """,
matched AS (SELECT rfv.experiment, rfv.label, prediction_rf, malware_probability_rf,
    prediction_zs, malware_probability_zs, prediction_ra, malware_probability_ra
  FROM rfv JOIN zsv ON zsv.experiment = rfv.experiment AND zsv.label = rfv.label
  JOIN rav ON rav.experiment = rfv.experiment AND rav.label = rfv.label)"""


@register("matched_join", O.q("SELECT * FROM matched", _MATCHED))
def _matched_join(i: Inputs):
    return compare.matched_join(_models(i))


@register("matched_cohort", O.q("""
SELECT rfv.experiment, rfv.label, prediction_rf, malware_probability_rf, prediction_zs, malware_probability_zs
FROM rfv JOIN zsv ON zsv.experiment = rfv.experiment AND zsv.label = rfv.label
WHERE rfv.experiment IN (SELECT experiment FROM rf WHERE year = 2024)""", _MATCHED))
def _matched_cohort(i: Inputs):
    """JN-04: two-way match restricted to the 2024 cohort."""
    rf = i.model("rf")
    m = compare.matched_join({"rf": rf, "zs": i.model("zs")})
    cohort = rf.where(F.col("year") == 2024).select("experiment")
    return m.join(cohort, "experiment", "left_semi")


_LONG = """scoped AS (SELECT m.*, s.scope FROM matched m
  JOIN (SELECT experiment, 'all' AS scope FROM rf UNION ALL
        SELECT experiment, 'year_2024' AS scope FROM rf WHERE year = 2024) s ON s.experiment = m.experiment),
cmp AS (""" + " UNION ALL ".join(
    f"SELECT scope || '/{m}' AS year, label, prediction_{m} AS prediction, malware_probability_{m} AS malware_probability FROM scoped"
    for m in ("rf", "zs", "ra")) + """),
ex AS (SELECT 'all' AS scope, count(*) AS expected FROM rf UNION ALL
       SELECT 'year_2024', count(*) FROM rf WHERE year = 2024)"""


@register("comparison_table", O.q(
    f"""SELECT split_part(grp, '/', 1) AS scope, split_part(grp, '/', 2) AS model, ex.expected,
       round(n / ex.expected, 4) AS coverage, {M_COLS} FROM met JOIN ex ON ex.scope = split_part(grp, '/', 1)
       WHERE grp <> 'all'""",
    _MATCHED, _LONG, O.metrics_sql("cmp", True, undefined="zero")[0]))
def _comparison_table(i: Inputs):
    """Every model in every scope, on the rows that all models answered, with coverage."""
    rf = i.model("rf")
    scopes = {"all": rf.select("experiment"), "year_2024": rf.where(F.col("year") == 2024).select("experiment")}
    return compare.comparison_table(_models(i), scopes)


@register("matched_metrics", O.q(
    f"SELECT split_part(grp, '/', 2) AS model, {M_COLS} FROM met WHERE grp LIKE 'all/%'",
    _MATCHED, _LONG, O.metrics_sql("cmp", True, undefined="zero")[0]))
def _matched_metrics(i: Inputs):
    """All models on the rows that all answered."""
    table = compare.comparison_table(_models(i), {"all": i.model("rf").select("experiment")})
    return table.select("model", *metrics.METRIC_COLUMNS)


@register("disagreement", O.q("""
SELECT count(*) AS n,
  count_if(prediction_rf = label AND prediction_ra = label) AS both_correct,
  count_if(prediction_rf = label AND prediction_ra <> label) AS rf_only,
  count_if(prediction_rf <> label AND prediction_ra = label) AS ra_only,
  count_if(prediction_rf <> label AND prediction_ra <> label) AS both_wrong,
  CASE WHEN count(*) > 0 THEN round(count_if(prediction_rf = label AND prediction_ra = label) / count(*), 9) END
    AS both_correct_share,
  CASE WHEN count(*) > 0 THEN round(count_if(prediction_rf = label AND prediction_ra <> label) / count(*), 9) END
    AS rf_only_share,
  CASE WHEN count(*) > 0 THEN round(count_if(prediction_rf <> label AND prediction_ra = label) / count(*), 9) END
    AS ra_only_share,
  CASE WHEN count(*) > 0 THEN round(count_if(prediction_rf <> label AND prediction_ra <> label) / count(*), 9) END
    AS both_wrong_share
FROM matched""", _MATCHED))
def _disagreement(i: Inputs):
    return compare.disagreement(compare.matched_join(_models(i)), "rf", "ra")


@register("exclusive_detections", O.q("""
SELECT count(*) AS malicious, count_if(prediction_rf = 'malicious') AS detected_rf,
  count_if(prediction_ra = 'malicious') AS detected_ra,
  count_if(prediction_rf = 'malicious' AND prediction_ra <> 'malicious') AS rf_not_ra,
  count_if(prediction_ra = 'malicious' AND prediction_rf <> 'malicious') AS ra_not_rf
FROM matched WHERE label = 'malicious'""", _MATCHED))
def _exclusive(i: Inputs):
    return compare.exclusive_detections(compare.matched_join(_models(i)), "rf", "ra")


@register("union_ensemble", O.q("""
SELECT count(*) AS malicious,
  count_if(prediction_rf = 'malicious' OR prediction_ra = 'malicious') AS detected_either,
  round(avg(CAST(prediction_rf = 'malicious' OR prediction_ra = 'malicious' AS DOUBLE)), 9) AS union_recall
FROM matched WHERE label = 'malicious'""", _MATCHED))
def _union(i: Inputs):
    return compare.union_ensemble(compare.matched_join(_models(i)), "rf", "ra")


# ------------------------------------------------------------------ splits
@register("temporal_split", O.q("""
SELECT experiment, label, year, test,
  CASE WHEN coalesce(year = 2024, false) THEN 'eval' ELSE 'train' END AS split
FROM labels_l WHERE coalesce(year = 2024, false) OR (NOT test AND year IS DISTINCT FROM 2024)"""))
def _temporal_split(i: Inputs):
    return splits.temporal_split(i.labels)


@register("official_split", O.q("""
SELECT experiment, label, year, test, CASE WHEN test THEN 'test' ELSE 'train' END AS split FROM labels_l"""))
def _official_split(i: Inputs):
    return splits.official_split(i.labels)


@register("history_pool", O.q("SELECT * FROM labels_l WHERE NOT test AND coalesce(year < 2024, false)"))
def _history_pool(i: Inputs):
    return splits.history_pool(i.labels)


@register("eval_subset_dev_2023", O.q("SELECT * FROM labels_l WHERE coalesce(year = 2023, false)"))
def _eval_dev(i: Inputs):
    return splits.eval_subset(i.labels, "dev_2023")


@register("first_n", O.q("SELECT * FROM labels_l ORDER BY experiment LIMIT 20"))
def _first_n(i: Inputs):
    """FLT-07: the pilot limit (a limit is the operator here)."""
    return splits.first_n(i.labels, 20)


_FOLD_ORDER = "(doc_id * 7919 + 13) % 1000003"


@register("stratified_folds", O.q(f"""
SELECT doc_id, quality AS label,
  CAST((row_number() OVER (PARTITION BY quality ORDER BY {_FOLD_ORDER}, doc_id) - 1) % 10 AS INTEGER) AS fold
FROM labels"""))
def _folds(i: Inputs):
    """WN-10 on the labels table, order = arithmetic hash (oracle-able)."""
    lab = i.table("labels").select("doc_id", F.col("quality").alias("label"))
    return splits.stratified_folds(lab, 10, order=[(F.col("doc_id") * 7919 + 13) % 1000003, F.col("doc_id")])


@register("fold_balance", O.q(f"""
SELECT label, fold, count(*) AS n FROM (
  SELECT quality AS label,
    CAST((row_number() OVER (PARTITION BY quality ORDER BY {_FOLD_ORDER}, doc_id) - 1) % 10 AS INTEGER) AS fold
  FROM labels) GROUP BY label, fold"""))
def _fold_balance(i: Inputs):
    lab = i.table("labels").select("doc_id", F.col("quality").alias("label"))
    f = splits.stratified_folds(lab, 10, order=[(F.col("doc_id") * 7919 + 13) % 1000003, F.col("doc_id")])
    return f.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


@register("balanced_sample", O.q("""
SELECT experiment, label, year, test FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY (CAST(experiment AS BIGINT) * 7919 + 13) % 1000003,
                               experiment) AS rn
  FROM labels_l) WHERE rn <= 10"""))
def _balanced_sample(i: Inputs):
    """WN-11: 10 per class in a seeded (arithmetic) order."""
    return splits.balanced_sample(i.labels, 10, order=[(F.col("experiment").cast("long") * 7919 + 13) % 1000003,
                                                       F.col("experiment")])


# ------------------------------------------------------------------ checks
@register("dup_keys", O.q("""
SELECT 'dup_keys' AS "check", count_if(c > 1) AS n_violations
FROM (SELECT experiment, count(*) AS c FROM labels_l GROUP BY experiment)"""))
def _dup_keys(i: Inputs):
    return checks.dup_keys(i.labels)


@register("label_domain_check", O.q("""
SELECT 'label_domain' AS "check", count(*) AS n_violations FROM (
  (SELECT DISTINCT label FROM labels_l EXCEPT SELECT unnest(['benign', 'malicious']))
  UNION ALL
  (SELECT unnest(['benign', 'malicious']) EXCEPT SELECT DISTINCT label FROM labels_l))"""))
def _label_domain(i: Inputs):
    return checks.label_domain_check(i.labels)


@register("missing_features", O.q("""
SELECT l.* FROM labels_l l WHERE NOT EXISTS (SELECT 1 FROM fc WHERE fc.experiment = l.experiment)""",
    O.FEATURE_COUNTS))
def _missing_features(i: Inputs):
    return checks.missing_features(i.labels, counts.feature_counts(i.trace))


@register("finite_check", O.q("""
SELECT 'finite' AS "check", count_if(""" + " OR ".join(
    f"{f} IS NULL OR isnan(CAST({f} AS DOUBLE)) OR isinf(CAST({f} AS DOUBLE))" for f in FEATURES) + """)
  AS n_violations FROM fc""", O.FEATURE_COUNTS))
def _finite(i: Inputs):
    return checks.finite_check(counts.feature_counts(i.trace), FEATURES)


@register("fold_range_check", O.q(f"""
SELECT 'fold_range' AS "check", count_if(fold < 0 OR fold >= 10) AS n_violations FROM (
  SELECT CAST((row_number() OVER (PARTITION BY quality ORDER BY {_FOLD_ORDER}, doc_id) - 1) % 10 AS INTEGER)
    AS fold FROM labels)"""))
def _fold_range(i: Inputs):
    lab = i.table("labels").select("doc_id", F.col("quality").alias("label"))
    f = splits.stratified_folds(lab, 10, order=[(F.col("doc_id") * 7919 + 13) % 1000003, F.col("doc_id")])
    return checks.fold_range_check(f)


@register("one_to_one_check", O.q("""
SELECT 'one_to_one' AS "check", count(*) AS n_violations FROM (
  SELECT experiment FROM (SELECT experiment FROM fc GROUP BY experiment HAVING count(*) > 1
                          UNION SELECT experiment FROM labels_l GROUP BY experiment HAVING count(*) > 1))""",
    O.FEATURE_COUNTS))
def _one_to_one(i: Inputs):
    return checks.one_to_one_check(counts.feature_counts(i.trace), i.labels)
