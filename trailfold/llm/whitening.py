"""Whitening of embeddings: eigenvectors of a distributed covariance, refined from float32.

Sums and centred products are added up by Spark; the covariance, one number per
pair of dimensions, goes to the driver.  Its eigenvectors are computed in
float32 and then corrected by the iteration of Ogita and Aishima, which
consists of matrix products in higher precision and squares the error each
time.  Eigenvalues so close together that a step would be long form a cluster,
inside which the iteration only keeps the vectors orthonormal; there the
matrix, shifted by the cluster's mean and seen in the cluster's own basis, is
solved again, and the iteration goes on with the parts told apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: The largest correction of one vector by another in one step.
LONG_STEP = 1e-4
_KINDS = {"float": (pa.float32(), np.float32), "double": (pa.float64(), np.float64)}


def refine(matrix: np.ndarray, vectors: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray, int]:
    """Eigenvalues (falling) and unit eigenvectors of a symmetric matrix from a rough guess, and the rounds it took.

    Products are taken in extended precision.  A guess of float32 needs two
    or three rounds, a cluster a sub-solve and as many again.
    """
    a = np.asarray(matrix, np.longdouble)
    a = (a + a.T) / 2
    size = len(a)
    norm = np.sqrt((a * a).sum())
    if size == 0 or norm == 0:
        return np.zeros(size), np.eye(size), 0
    x = np.asarray(vectors, np.longdouble)
    eye = np.eye(size, dtype=np.longdouble)
    enough = 4 * size * np.finfo(np.longdouble).eps
    done = 0
    for done in range(1, rounds + 1):
        r = eye - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        mean = (values[None, :] + values[:, None]) / 2
        wrong = s - np.diag(np.diag(s)) + mean * (r - np.diag(np.diag(r)))
        if np.abs(wrong).max() <= enough * norm and np.abs(r).max() <= enough:
            break
        gap = values[None, :] - values[:, None]
        # a step is exact up to its square: pairs that would need a long one are a cluster
        settled = np.abs(wrong) <= enough * norm
        near = ~settled & (np.abs(wrong) >= LONG_STEP * np.abs(gap))
        # (s + value * r) / gap, written so that what turns a pair is antisymmetric to the last bit
        x = x + x @ (r / 2 + np.where(near | settled, 0, wrong / np.where(near | settled, 1, gap)))
        for block in _clusters(values, near):
            x[:, block] = _within(a, x[:, block])
    turn = np.argsort(-values, kind="stable")
    return values[turn].astype(np.float64), x[:, turn].astype(np.float64), done


def _clusters(values: np.ndarray, near: np.ndarray) -> list[np.ndarray]:
    """Places of eigenvalues that pairs in ``near`` hold together, with all that lie between them."""
    turn = np.argsort(values, kind="stable")
    held = np.zeros(len(values) + 1, np.int64)
    p, q = np.nonzero(np.triu(near[np.ix_(turn, turn)], 1))
    np.add.at(held, p, 1)
    np.add.at(held, q, -1)
    cut = np.flatnonzero(np.cumsum(held)[:-1] == 0) + 1
    return [block for block in np.split(turn, cut) if len(block) > 1]


def _orthonormal(basis: np.ndarray) -> np.ndarray:
    """A nearly orthonormal basis made so to rounding."""
    return basis + basis @ ((np.eye(basis.shape[1], dtype=np.longdouble) - basis.T @ basis) / 2)


def _within(a: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The basis of a cluster turned to the eigenvectors of the matrix as seen in it, less its mean."""
    basis = _orthonormal(basis)
    mean = np.einsum("ij,ij->", basis, a @ basis) / basis.shape[1]
    small = basis.T @ (a @ basis - mean * basis)
    small = (small + small.T) / 2
    most = np.abs(small).max()
    if most == 0:
        return basis
    _, turn = np.linalg.eigh((small / most).astype(np.float64))
    return _orthonormal(basis @ turn.astype(np.longdouble))


@dataclass
class Whitening:
    """What tasks need: row count, exact sums, integer centre, remainder of the mean, and the scaled components."""
    n: int
    sums: list[int]
    centre: np.ndarray
    rest: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    rounds: int = 0


def _integers(batch: pa.RecordBatch, size: int | None, kinds: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part (of ``size`` finite entries) and their entries as whole numbers."""
    column = batch.column("v")
    valid = np.asarray(column.is_valid())
    offsets = column.offsets.to_numpy()
    sizes = np.where(valid, np.diff(offsets), -1)
    values = column.values.cast(kinds[0])
    flat = values.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
    rows = np.flatnonzero(sizes == size)
    x = flat[offsets[rows][:, None] + np.arange(size)] if len(rows) else np.zeros((0, size))
    fine = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        whole = np.floor(x[fine] * SCALE)
    whole = np.clip(whole, -2.0**62, 2.0**62).astype(np.int64) + SHIFT
    return rows[fine], whole


def _task(size: int, kinds: tuple, make: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _integers(batch, size, kinds)
            if len(rows):
                yield make(batch, rows, x)
    return run


def _added(vectors: DataFrame, run: Callable, width: int) -> np.ndarray:
    """The sum of all rows (i, v: array of ``width`` doubles) that the tasks give, added up by Spark, as a matrix."""
    parts = vectors.mapInArrow(run, "i int, v array<double>")
    total = (parts.select("i", F.posexplode("v").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect())
    out = np.zeros((max((r["i"] for r in total), default=-1) + 1, width))
    for r in total:
        out[r["i"], r["j"]] = r["x"]
    return out


def _matrix_rows(m: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(m)), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], ["i", "v"])


def _usual_size(rows: DataFrame) -> int:
    """The length most vectors have, of those without null or non-finite entries (ties: the larger; none: 0)."""
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    found = (rows.filter(F.col("v").isNotNull() & ~bad).groupBy(F.size("v").alias("s")).agg(F.count(F.lit(1)).alias("c"))
             .orderBy(F.desc("c"), F.desc("s")).first())
    return found["s"] if found else 0


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The components of all vectors, repeated ones included; None where no vector takes part."""
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    kinds = _KINDS.get(element, _KINDS["double"])
    rows = vectors.select(vectors[vector_col].alias("v"))
    size = _usual_size(rows)
    if not size:
        return None
    # exact sums: whole numbers, each batch's added in Python's integers where they could overflow
    parts = rows.mapInArrow(_task(size, kinds, lambda b, r, x: pa.RecordBatch.from_arrays(
        [pa.array([len(x)], pa.int64()), pa.array([[str(int(s)) for s in _exact(x)]])], ["n", "s"])), "n long, s array<string>")
    sums = (parts.select("n", F.posexplode("s").alias("j", "s")).groupBy("j")
            .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("j").collect())
    n, total = sums[0]["n"], [int(r["s"]) for r in sums]
    centre = np.array([round(Fraction(s, n)) for s in total], np.int64)
    rest = np.array([float(Fraction(s, n) - int(c)) for s, c in zip(total, centre)])

    def products(batch: pa.RecordBatch, rows: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        y = (x - centre).astype(np.float64)
        return _matrix_rows(y.T @ y)

    gram = _added(rows, _task(size, kinds, products), size)
    cov = np.asarray(gram, np.longdouble) / n - np.outer(rest.astype(np.longdouble), rest)
    cov = (cov + cov.T) / 2
    most = np.abs(cov).max()
    _, rough = np.linalg.eigh((cov / (most or 1)).astype(np.float32))
    values, axes, rounds = refine(cov, rough)
    trace = float(np.trace(cov))
    real = [i for i in range(min(components, size)) if values[i] > size * np.finfo(np.float64).eps * values[0]]
    values, axes = values[real], axes[:, real]
    return Whitening(n, total, centre, rest, axes / np.sqrt(values), values, values / (trace or 1), rounds)


def _exact(x: np.ndarray) -> np.ndarray:
    safe = len(x) == 0 or float(np.abs(x.astype(np.float64)).max()) * len(x) < 2.0**62
    return x.sum(axis=0) if safe else x.astype(object).sum(axis=0)


def components_of(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                  components: int = COMPONENTS) -> DataFrame:
    """Per row that takes part and component: ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Rows whose vector is null or holds null or non-finite entries take no
    part, nor do those of another length than most.  Every other row gives its
    rows, repeated ones and those of a null id too, and counts in the fit.
    Components without variance (of constant or dependent dimensions, or of a
    single row) have no rows; where nothing takes part there are none at all.
    ``deviation`` is null where it does not fit a long.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(vectors, vector_col, components)
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].alias("v"))
    if model is None or not len(model.values):
        return (rows.select("id").limit(0).withColumns(
            {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in schema.split(", ")}).withColumnRenamed("id", id_col))
    kinds = _KINDS.get(vectors.schema[vector_col].dataType.elementType.simpleString(), _KINDS["double"])
    size, k, n = len(model.centre), len(model.values), model.n

    def projected(x: np.ndarray) -> np.ndarray:
        return ((x - model.centre).astype(np.float64) - model.rest) @ model.axes

    def products(batch: pa.RecordBatch, rows: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        w = projected(x)
        return _matrix_rows(np.vstack([w.T @ w, w.sum(axis=0)]))

    added = _added(rows.select("v"), _task(size, kinds, products), k)
    mean = added[k] / n
    error = float(np.abs(added[:k] / n - np.outer(mean, mean) - np.eye(k)).max())
    sums = np.array(model.sums, object)

    def give(batch: pa.RecordBatch, rows: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        far = float(n) * (x - model.centre).astype(np.float64) - n * model.rest
        rough = (far * far).sum(axis=1)
        if rough.max() < 2.0**62:
            # n*x - S around the integer centre: small, and so exact in 64 bits
            left = np.array([int(s) for s in n * model.centre.astype(object) - sums], np.int64)
            d = n * (x - model.centre) + left
            deviation = (d * d).sum(axis=1).tolist()
        else:
            exact = [int(((n * r.astype(object) - sums) ** 2).sum()) for r in x]
            deviation = [v if v < 2**63 else None for v in exact]
        w = projected(x)
        return pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(rows)), pa.array(deviation, pa.int64()), pa.array(list(w), pa.list_(pa.float64()))],
            ["id", "deviation", "w"])

    out = rows.mapInArrow(_task(size, kinds, give), f"id {kind}, deviation long, w array<double>")
    explained = F.array(*[F.lit(float(e)) for e in model.explained])
    return (out.select("id", "deviation", F.posexplode("w").alias("c", "whitened"))
            .select(F.col("id").alias(id_col), (F.col("c") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                    "whitened", explained[F.col("c")].alias("explained"), F.lit(error).alias("identity_error")))
