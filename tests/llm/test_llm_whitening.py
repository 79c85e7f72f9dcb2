"""Whitened components against numpy, and the refinement on matrices of known eigenvectors."""

import math
from collections import defaultdict

import llm_cases as cases
import numpy as np
import pytest

from trailfold.llm import queries, whitening as W
from trailfold.llm.common import table


def brute(rows):
    """(values, vectors, x, n, S): eigenpairs in double precision, falling."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in rows], np.int64)
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return values[::-1], vectors[:, ::-1], x, n, s


def check(got, rows, most=8):
    values, vectors, x, n, s = brute(rows)
    by_id = defaultdict(list)
    for r in got:
        by_id[r["vec_id"]].append(r)
    assert len(got) == len(rows) * min(most, x.shape[1]) and len({r["identity_error"] for r in got}) == 1
    assert got[0]["identity_error"] <= 1e-4
    sign = {}
    for (vec_id, _), xi in zip(rows, x):
        deviation = sum((n * int(a) - int(b)) ** 2 for a, b in zip(xi, s))
        found = sorted(by_id[vec_id], key=lambda r: r["component"])
        for c, r in enumerate(found):
            assert r["component"] == c + 1 and r["n"] == n and r["deviation"] == deviation
            assert r["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9)
            want = (xi - s / n) @ vectors[:, c] / math.sqrt(values[c])
            if c not in sign and abs(want) > 1e-3:
                sign[c] = 1 if want * r["whitened"] > 0 else -1
            assert r["whitened"] == pytest.approx(sign.get(c, 1) * want, abs=1e-6)


def test_refinement_reaches_double_precision():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    for values in (np.linspace(1, 100, 40), np.concatenate([np.full(5, 7.0), [7 + 1e-9, 7 + 3e-9, 90, 90 + 1e-6], np.linspace(8, 60, 31)]),
                   np.ones(40), np.concatenate([[1e6], np.linspace(1e-3, 1, 39)])):
        a = (q * values) @ q.T
        a = (a + a.T) / 2
        _, rough = np.linalg.eigh(a.astype(np.float32))
        got, x, rounds = W.refine(a, rough)
        exact = np.sort(np.linalg.eigvalsh(a))[::-1]
        assert np.abs(got - exact).max() <= 1e-13 * np.abs(values).max()
        assert np.abs(x.T @ x - np.eye(40)).max() < 4e-16 * 4
        assert np.abs(a @ x - x * got).max() <= 4e-14 * np.abs(values).max()
        assert rounds <= 6
    # well apart: the vectors themselves
    a = (q * np.linspace(1, 100, 40)) @ q.T
    _, x, _ = W.refine(a, np.linalg.eigh(a.astype(np.float32))[1])
    assert np.abs(np.abs(x.T @ q[:, ::-1]) - np.eye(40)).max() < 1e-13
    assert W.refine(np.zeros((3, 3)), np.eye(3))[0].tolist() == [0, 0, 0]


def test_close_eigenvalues_are_told_apart():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(20, 20)))
    values = np.concatenate([[5, 5 + 1e-7, 5 + 2e-7], np.linspace(6, 30, 17)])
    a = (q * values) @ q.T
    got, x, _ = W.refine(a, np.linalg.eigh(a.astype(np.float32))[1])
    assert np.abs(x.T @ a @ x - np.diag(got)).max() < 1e-13
    # 1e-7 apart, so turned by rounding of 1e-15 / 1e-7 at most
    assert np.abs(np.abs(x[:, -1] @ q[:, 0]) - 1) < 1e-12


@pytest.mark.parametrize("kind", ["float", "double"])
def test_components_equal_numpy(spark, kind):
    rng = np.random.default_rng(5)
    mixed = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 12)) + 0.1 * rng.normal(size=(300, 12))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(mixed)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(4)
    check(W.components_of(df).collect(), rows)
    # fewer dimensions than components
    few = [(i, v[:3]) for i, v in rows]
    check(W.components_of(spark.createDataFrame(few, f"vec_id long, embedding array<{kind}>")).collect(), few)


def test_awkward_vectors(spark):
    good = [(i, [float(i), float(i * i % 7), 1.0]) for i in range(10)] + [(3, [3.0, 2.0, 1.0]), (None, [1.0, 5.0, 1.0])]
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [1.0, float("nan"), 2.0]), (53, [float("inf"), 1.0, 2.0]), (54, [1.0]), (55, [])]
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame(good + bad, schema)
    df = df.selectExpr("*", "'a' as id", "1 as component", "2 as n", "3 as v", "4 as w")
    got = W.components_of(df).collect()
    # the third dimension is constant: two components; repeated rows and those of a null id count
    assert len(got) == 2 * len(good) and {r["component"] for r in got} == {1, 2}
    assert {r["n"] for r in got} == {len(good)} and {r["vec_id"] for r in got} == {i for i, _ in good}
    for none in (df.limit(0), spark.createDataFrame(bad[:4] + bad[5:], schema), spark.createDataFrame([(1, [1.0, 2.0])], schema)):
        out = W.components_of(none)
        assert out.count() == 0
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    # deviations beyond 64 bits are null, in exact ones no step overflows
    big = spark.createDataFrame([(i, [float(i % 5) * 1e6, float(i)]) for i in range(60)], schema)
    want = {}
    x = [[math.floor(1024 * c) + 100_000 for c in (float(i % 5) * 1e6, float(i))] for i in range(60)]
    s = [sum(c) for c in zip(*x)]
    for i, xi in enumerate(x):
        d = sum((60 * a - b) ** 2 for a, b in zip(xi, s))
        want[i] = d if d < 2**63 else None
    assert {r["vec_id"]: r["deviation"] for r in W.components_of(big).collect()} == want and None in want.values()


@pytest.mark.skipif(not cases.HAVE_SF, reason="driver test data not present")
def test_query_equals_numpy_on_real_vectors(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, cases.SF, "embeddings").collect()]
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    check(queries.op13_embedding_whitening(spark, cases.SF).collect(), rows)
