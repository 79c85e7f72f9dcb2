"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Equal vectors are one point.  For the largest inner product each point gets
one more coordinate that makes all points equally long, so nearer in angle is
nearer in product.  A tree halves a bounded sample of points again and again
at the median of a projection onto the difference of two of them; every point
of the table is filed in its leaf of every tree.

A query takes leaves from one queue that all trees share, in the order of the
largest distance by which it lies on the wrong side of a split on the way
there, until it has seen a volume of points.  That volume is measured on the
sample: what the wanted share of true neighbours needs.  The visited leaves
are joined with the queries, candidates are ranked by the exact product in
double precision, and what does not reach the query's k-th best point of the
sample, among those in its leaves, is not shipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailfold.llm.common import saved

TREES, LEAF, RECALL = 8, 256, 0.97
#: The sample that trees and volume are fitted on: points, and bytes at most.
SAMPLE, SAMPLE_BYTES = 20_000, 24 << 20
#: Queries that meet one leaf in one task.
TOGETHER = 20_000


def points_of(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec as bytes, norm2) of the rows that take part: finite, not null, not zero, with an id."""
    wide = vectors.schema[vector_col].dataType.elementType.simpleString() != "float"
    kind = np.float64 if wide else np.float32
    arrow = pa.float64() if wide else pa.float32()
    id_kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("v")
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().cast(arrow).fill_null(math.nan).to_numpy(zero_copy_only=False).astype(kind)
            # a null list has no values of its own in flatten()
            sizes = np.where(np.asarray(column.is_valid()), sizes, 0)
            ends = np.cumsum(sizes)
            row = np.repeat(np.arange(len(sizes)), sizes)
            square = np.bincount(row, flat.astype(np.float64) ** 2, len(sizes))
            ok = np.flatnonzero(np.isfinite(square) & (square > 0) & np.asarray(b.column("id").is_valid()))
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(ok)),
                 pa.array([flat[ends[i] - sizes[i]:ends[i]].tobytes() for i in ok], pa.binary()), pa.array(square[ok])],
                ["id", "vec", "norm2"])

    return (vectors.select(vectors[id_col].alias("id"), vectors[vector_col].alias("v"))
            .mapInArrow(run, f"id {id_kind}, vec binary, norm2 double"))


@dataclass
class Forest:
    """Splits of perfect binary trees: planes (trees, nodes, dimensions + 1) and thresholds (trees, nodes)."""
    planes: np.ndarray
    cuts: np.ndarray
    depth: int
    longest2: float
    sample: np.ndarray
    sample_ids: np.ndarray
    share: np.ndarray
    filed: np.ndarray
    volume: float = 1.0

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest2 - (x ** 2).sum(axis=1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each point in each tree (points x trees)."""
        y = self.lifted(x)
        out = np.zeros((len(x), len(self.planes)), np.int64)
        for t in range(len(self.planes)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", y, self.planes[t][node]) > self.cuts[t][node]
                node = 2 * node + 1 + right
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def queue(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All leaves of all trees in each query's order, and the volume seen with each."""
        y = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
        wrong = []
        for t in range(len(self.planes)):
            behind = np.zeros((len(q), 1))
            for level in range(self.depth):
                nodes = np.arange((1 << level) - 1, (2 << level) - 1)
                side = y @ self.planes[t][nodes].T - self.cuts[t][nodes]
                both = np.stack([np.maximum(behind, side), np.maximum(behind, -side)], axis=2)
                behind = both.reshape(len(q), -1)
            wrong.append(behind)
        order = np.argsort(np.concatenate(wrong, axis=1), axis=1, kind="stable")
        return order, np.cumsum(self.share.ravel()[order], axis=1)

    def visited(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, tree * leaves + leaf) pairs up to the volume."""
        order, seen = self.queue(q)
        last = np.minimum((seen < self.volume).sum(axis=1) + 1, order.shape[1])
        take = np.arange(order.shape[1])[None, :] < last[:, None]
        return np.nonzero(take)[0], order[take]


def grow(sample: np.ndarray, ids: np.ndarray, total: int, longest2: float, k: int, trees: int = TREES, leaf: int = LEAF,
         recall: float = RECALL) -> Forest:
    """A forest over a sample of distinct points for ``total`` points in all."""
    rng = np.random.default_rng(len(sample))
    depth = max(0, min(math.ceil(math.log2(max(1, total / leaf))), int(math.log2(max(1, len(sample) / 8)))))
    nodes = (1 << depth) - 1
    forest = Forest(np.zeros((trees, nodes, sample.shape[1] + 1)), np.zeros((trees, nodes)), depth, longest2, sample, ids,
                    np.zeros((trees, 1 << depth)), np.zeros((0, trees), np.int64))
    y = forest.lifted(sample)
    for t in range(trees):
        held: list[np.ndarray] = [np.arange(len(sample))]
        for node in range(nodes):
            own = held[node]
            a, b = rng.choice(own, 2, replace=False) if len(own) > 1 else rng.choice(len(sample), 2, replace=False)
            plane = y[a] - y[b]
            plane /= max(float(np.linalg.norm(plane)), 1e-12)
            along = y[own] @ plane
            half = len(own) // 2
            # between the two in the middle, so that no sampled point lies on the split
            middle = np.partition(along, [max(half - 1, 0), half])[max(half - 1, 0):half + 1] if len(own) else np.zeros(1)
            forest.planes[t, node], forest.cuts[t, node] = plane, middle.mean()
            held += [own[along <= forest.cuts[t, node]], own[along > forest.cuts[t, node]]]
        forest.share[t] = [len(h) / len(sample) for h in held[nodes:]]
    forest.filed = forest.leaves(sample) + np.arange(trees) * (1 << depth)
    # the volume that the wanted share of a sample's true neighbours needs
    some = rng.choice(len(sample), min(256, len(sample)), replace=False)
    scores = sample[some] @ sample.T
    scores[np.arange(len(some)), some] = -np.inf
    near = np.argsort(-scores, axis=1)[:, :min(k, len(sample) - 1)]
    if near.size and depth:
        order, seen = forest.queue(sample[some])
        needed = np.empty_like(seen)
        np.put_along_axis(needed, order, seen, axis=1)
        least = np.array([needed[i][forest.filed[n]].min(axis=1) for i, n in enumerate(near)])
        forest.volume = float(np.quantile(least, recall)) * (1 + 1e-9)
    else:
        forest.volume = float(trees)
    return forest


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           trees: int = TREES, leaf: int = LEAF, recall: float = RECALL) -> DataFrame:
    """Per query: its ``k`` nearest other rows found, as query_id, rank (from 1), the id, score.

    ``is_query`` is a condition on ``id_col``.  Rows whose id or vector is
    null, whose vector is empty, zero or holds null or non-finite values, or
    has another length than most, take no part.  Rows with equal id and vector
    count once; of equal scores the smaller id comes first; fewer than ``k``
    candidates give fewer rows, an empty table none.
    """
    spark = vectors.sparkSession
    rows = points_of(vectors, id_col, vector_col)
    sized = rows.withColumn("size", F.length("vec"))
    common = sized.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    wanted = F.col("size") == (common["size"] if common else 0)
    known = saved(sized.filter(wanted).select("id", "vec", "norm2").distinct().withColumn("point", F.xxhash64("vec")))
    wide = vectors.schema[vector_col].dataType.elementType.simpleString() != "float"
    kind = np.float64 if wide else np.float32
    id_kind = vectors.schema[id_col].dataType.simpleString()
    asked = is_query.alias("asked")
    flagged = known.withColumnRenamed("id", id_col).withColumn("asked", F.coalesce(asked, F.lit(False))).withColumnRenamed(id_col, "id")
    # one row for each different vector, whether it is a query's and how many rows hold it
    points = saved(flagged.groupBy("point").agg(F.first("vec").alias("vec"), F.max("norm2").alias("norm2"),
                                                F.max("asked").alias("asked")))
    about = points.agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("m"), F.sum(F.col("asked").cast("int")).alias("q")).first()
    result = f"query_id {id_kind}, rank int, {id_col} {id_kind}, score double"
    if not about["n"] or not about["q"]:
        return spark.createDataFrame([], result)
    bound = max(64, min(SAMPLE, SAMPLE_BYTES // common["size"]))
    # point is a hash, so its smallest values are a random sample
    picked = points.select("point", "vec").orderBy("point").limit(bound).collect()
    sample = np.frombuffer(b"".join(bytes(r["vec"]) for r in picked), kind).reshape(len(picked), -1).astype(np.float64)
    forest = grow(sample, np.array([r["point"] for r in picked], np.int64), about["n"], about["m"], k, trees, leaf, recall)
    shared = spark.sparkContext.broadcast(forest)
    parts = max(1, -(-about["q"] // TOGETHER))

    def matrix(column) -> np.ndarray:
        raw = [v.as_buffer() for v in column] if isinstance(column, pa.Array) else column
        return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                b = whole.slice(a, 2048)
                places = f.leaves(matrix(b.column("vec"))) + np.arange(len(f.planes)) * (1 << f.depth)
                row = pa.array(np.repeat(np.arange(b.num_rows), len(f.planes) * parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(places.ravel(), parts).astype(np.int32)),
                     pa.array(np.tile(np.arange(parts, dtype=np.int32), places.size)),
                     b.column("point").take(row), b.column("vec").take(row)], ["leaf", "part", "point", "vec"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                b = whole.slice(a, 256)
                q, own = matrix(b.column("vec")), b.column("point").to_numpy()
                product = q @ f.sample.T
                product[own[:, None] == f.sample_ids[None, :]] = -np.inf
                row, place = f.visited(q)
                # the k-th best of the sample's points that will be met: no worse candidate can count
                met = np.zeros((len(q), f.share.size), bool)
                met[row, place] = True
                product[~reduce(np.logical_or, [met[:, leaf] for leaf in f.filed.T])] = -np.inf
                floor = -np.partition(-product, k - 1, axis=1)[:, k - 1] if product.shape[1] >= k else np.full(len(q), -np.inf)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place.astype(np.int32)), pa.array((own[row] % parts).astype(np.int32)), pa.array(own[row]),
                     b.column("vec").take(pa.array(row)), pa.array(floor[row])], ["leaf", "part", "point", "vec", "floor"])

    def rank(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(candidates) and len(queries):
            x, ids = matrix(list(candidates["vec"])), candidates["point"].to_numpy()
            q, own, floor = matrix(list(queries["vec"])), queries["point"].to_numpy(), queries["floor"].to_numpy()
            step = max(1, (4 << 20) // len(x))
            for a in range(0, len(q), step):
                score = q[a:a + step] @ x.T
                if len(x) > k + 1:
                    least = -np.partition(-score, k, axis=1)[:, k]
                else:
                    least = np.full(len(score), -np.inf)
                # a little below the floor: it was summed in another order
                i, j = np.nonzero(score >= np.maximum(least, floor[a:a + step] - 1e-9 * (1 + np.abs(floor[a:a + step])))[:, None])
                found.append(pd.DataFrame({"query": own[a + i], "point": ids[j], "score": score[i, j]}))
        return pd.concat(found) if found else pd.DataFrame({"query": pd.Series(dtype="int64"), "point": pd.Series(dtype="int64"),
                                                            "score": pd.Series(dtype="float64")})

    filed = points.select("point", "vec").mapInArrow(file, "leaf int, part int, point long, vec binary")
    visits = (points.filter("asked").select("point", "vec")
              .mapInArrow(visit, "leaf int, part int, point long, vec binary, floor double"))
    hits = (filed.groupBy("leaf", "part").cogroup(visits.groupBy("leaf", "part"))
            .applyInPandas(rank, "query long, point long, score double"))
    hits = hits.groupBy("query", "point").agg(F.max("score").alias("score"))
    # the best points, then their rows: of each point no more than k + 1 can count
    top = hits.withColumn("n", F.dense_rank().over(Window.partitionBy("query").orderBy(F.desc("score")))).filter(F.col("n") <= k + 1)
    by_id = Window.partitionBy("point").orderBy("id")
    few = known.select("id", "point").withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= k + 1)
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    wide_top = (top.select("query", "point", "score").join(few.select("id", "point"), "point")
                .withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= k + 1).select("query", "id", "score"))
    queries = flagged.filter("asked").select(F.col("id").alias("query_id"), F.col("point").alias("query")).distinct()
    per_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (queries.join(wide_top, "query").filter(F.col("id") != F.col("query_id"))
            .groupBy("query_id", "id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(per_query)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score"))
