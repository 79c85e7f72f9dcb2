"""Metric operators against golden vectors and brute force."""

import numpy as np
import pytest

from helpers import one

from trailfold.operators import metrics

SCHEMA = "label string, prediction string, malware_probability double, year int"


def _rows(tn, fp, fn, tp, year=2024):
    out = []
    out += [("benign", "benign", 0.1, year)] * tn
    out += [("benign", "malicious", 0.9, year)] * fp
    out += [("malicious", "benign", 0.2, year)] * fn
    out += [("malicious", "malicious", 0.8, year)] * tp
    return out


def test_published_confusion_golden(spark):
    df = spark.createDataFrame(_rows(11372, 880, 311, 2056), SCHEMA)
    m = one(metrics.binary_metrics(df))
    assert (m.tn, m.fp, m.fn, m.tp, m.n) == (11372, 880, 311, 2056, 14619)
    assert round(m.accuracy, 6) == 0.918531
    assert round(m.malware_recall, 6) == 0.868610
    assert round(m.malware_precision, 6) == 0.700272
    assert round(m.malware_f1, 6) == 0.775410
    assert round(m.benign_fpr, 6) == 0.071825
    assert round(m.balanced_accuracy, 6) == 0.898393


@pytest.mark.parametrize("rows,expected", [
    ([("malicious", "benign", 0.1, 0)] * 10 + [("benign", "malicious", 0.9, 0)] * 10, 0.4736842105),
    ([("malicious", "malicious", 1.0, 0)] * 5 + [("malicious", "benign", 0.0, 0)] * 5
     + [("benign", "benign", 0.5, 0)] * 10, 0.7368421053),
    ([("malicious", "malicious", 0.9, 0)] * 3 + [("benign", "benign", 0.1, 0)] * 3, 1.0),
])
def test_partial_auc_closed_forms(spark, rows, expected):
    m = one(metrics.binary_metrics(spark.createDataFrame(rows, SCHEMA)))
    assert abs(m.partial_auc_max_fpr_0_1 - expected) < 1e-9


def _pair_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    d = pos[:, None] - neg[None, :]
    return ((d > 0).sum() + 0.5 * (d == 0).sum()) / (len(pos) * len(neg))


def _partial_ref(y, s, max_fpr=0.1):
    # ROC by distinct thresholds, clipped at max_fpr by interpolation, McClish standardised
    order = np.argsort(-s, kind="mergesort")
    ys, ss = y[order], s[order]
    distinct = np.r_[np.nonzero(np.diff(ss))[0], len(ss) - 1]
    tps = np.cumsum(ys)[distinct]
    fps = (1 + distinct) - tps
    tpr = np.r_[0, tps / tps[-1]]
    fpr = np.r_[0, fps / fps[-1]]
    stop = np.searchsorted(fpr, max_fpr, "right")
    x = np.r_[fpr[:stop], max_fpr]
    yv = np.r_[tpr[:stop], np.interp(max_fpr, fpr[stop - 1:stop + 1], tpr[stop - 1:stop + 1])]
    area = np.trapezoid(yv, x)
    mn, mx = 0.5 * max_fpr ** 2, max_fpr
    return 0.5 * (1 + (area - mn) / (mx - mn))


def test_auc_matches_pair_count_with_ties(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400) * 0.5 + y * 0.3, 2)   # coarse scores -> many ties
    rows = [("malicious" if a else "benign", "benign", float(b), 0) for a, b in zip(y, s)]
    m = one(metrics.binary_metrics(spark.createDataFrame(rows, SCHEMA)))
    assert abs(m.roc_auc - _pair_auc(y, s)) < 1e-9
    assert abs(m.partial_auc_max_fpr_0_1 - _partial_ref(y, s)) < 1e-9


def test_undefined_policies(spark):
    mal_only = spark.createDataFrame([("malicious", "malicious", 0.9, 1), ("malicious", "benign", 0.2, 1)], SCHEMA)
    m = one(metrics.binary_metrics(mal_only))
    assert m.accuracy == 0.5 and m.benign_fpr is None and m.balanced_accuracy is None and m.roc_auc is None
    ben_only = spark.createDataFrame([("benign", "malicious", 0.9, 1), ("benign", "benign", 0.2, 1)], SCHEMA)
    m = one(metrics.binary_metrics(ben_only))
    assert m.malware_recall is None and m.malware_f1 is None and m.malware_precision == 0.0
    assert m.partial_auc_max_fpr_0_1 is None
    z = one(metrics.binary_metrics(ben_only, undefined="zero"))
    assert z.malware_recall == 0.0 and z.balanced_accuracy == 0.0 and z.roc_auc is None


def test_empty_prediction_set(spark):
    m = one(metrics.binary_metrics(spark.createDataFrame([], SCHEMA)))
    assert m.n == 0 and m.accuracy is None and m.roc_auc is None


def test_grouping_sets_with_null_year(spark):
    rows = _rows(2, 1, 1, 2, 2020) + _rows(1, 0, 0, 1, None)
    out = metrics.metrics_by_group(spark.createDataFrame(rows, SCHEMA), "year", "x").collect()
    assert [r.year for r in out] == ["all", "2020", "unknown"]
    g = {r.year: r for r in out}
    assert g["all"].n == 8 and g["2020"].n == 6 and g["unknown"].n == 2


def test_failures_never_benign(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("benign", "benign", 0.1, 0), ("malicious", None, None, 0),
                                ("benign", "benign", 0.2, 0), ("malicious", None, None, 0)], SCHEMA)
    c = one(metrics.coverage(df, expected=4))
    assert (c.failures, c.valid_predictions, c.coverage) == (2, 2, 0.5)
    m = one(metrics.binary_metrics(df.where(metrics.valid_mask(df))))
    assert (m.benign, m.malicious) == (2, 0)
    assert F is not None
