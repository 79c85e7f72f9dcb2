"""Random forests whose trees each grow whole in one task (ML-01, 02, 04, 06).

MLlib grows a forest in one job a level, and each node costs it a table of all
bins, however few rows it has.  Here the rows are put into bins once, as one byte a feature,
and every task holds that table; it grows some trees, level by level for all of
their nodes, scores the rows that are asked for and keeps no tree.  The table is bounded
(``TABLE_BYTES``); ``models`` leaves larger ones to MLlib.

As in MLlib: bins at most ``bins`` a feature, cut from up to 10,000 learning rows; rows
drawn with Poisson weights; at each node ``ceil(sqrt(features))`` features,
the split of most gini gain, a leaf where there is none; two leaves of one
decision are one; a row's probability is the mean of its leaves' shares.
A missing value of a scored row is beyond all others; learning rows have none.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailfold.session import checkpoint_dir

TABLE_BYTES = 64 << 20   # the table of bins: on the driver once, and in every task
ROWS_FOR_BINS = 10_000   # as MLlib
ROW_TREES = 1_000_000    # rows times trees of one task
AT_ONCE = 1 << 16        # rows times trees worked on at once
BLOCK = 4096             # scored rows of a record


@dataclass(frozen=True)
class Forest:
    """A forest that learns from the rows of some groups and scores those of others."""
    features: tuple[str, ...]
    trees: int
    seed: int
    depth: int
    bins: int
    learns: frozenset[int]
    scores: frozenset[int]


def table_bytes(rows: int, forests: list[Forest]) -> int:
    return rows * (len({(c, f.learns, f.bins) for f in forests for c in f.features}) + 32)


def thresholds(values: np.ndarray, bins: int) -> np.ndarray:
    """Upper ends of all bins but the last, as MLlib finds them: halfway between values, by counts if they are many."""
    distinct, counts = np.unique(values, return_counts=True)
    splits = min(bins, len(values)) - 1
    half = distinct[:-1] / 2 + distinct[1:] / 2
    if len(half) <= splits:
        return half
    stride = len(values) / (splits + 1)
    found, target = [], stride
    for cut, before, after in zip(half, np.cumsum(counts)[:-1].tolist(), np.cumsum(counts)[1:].tolist()):
        if abs(before - target) < abs(after - target):
            found.append(cut)
            target += stride
    return np.array(found)


def grow(codes: np.ndarray, y: np.ndarray, weights: np.ndarray, depth: int, bins: int,
         rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """One tree for each row of ``weights``: per node its feature (-1: leaf), cut, left child and share of class 1.

    ``codes`` has one row a feature, ``y`` and ``weights`` (below 256) one column a row.
    The first nodes are the roots; a right child follows its left one; codes up to the cut go left.
    """
    size, n = codes.shape
    flat, sample = codes.ravel(), int(np.ceil(np.sqrt(size)))
    node, at = np.nonzero(weights)
    weight = weights[node, at].astype(np.int64)
    mark = weight | y[at].astype(np.int64) << 8
    total = np.bincount(node, weight, len(weights)).astype(np.int64)
    ones = np.bincount(node, weight * y[at], len(weights)).astype(np.int64)
    levels = []
    first = 0
    for level in range(depth + 1):
        feature, cut, left = (np.full(len(total), x, np.int64) for x in (-1, 0, 0))
        levels.append([feature, cut, left, total, ones])
        first += len(total)
        mixed = (ones > 0) & (ones < total)
        if level == depth or not mixed.any():
            break
        # nodes that can be split, numbered anew, and their rows
        some = mixed[node]
        node, at, mark = (np.cumsum(mixed) - 1)[node[some]], at[some], mark[some]
        own, own_ones, m = total[mixed], ones[mixed], int(mixed.sum())
        before, before_ones = np.cumsum(own) - own, np.cumsum(own_ones) - own_ones
        chosen = np.argpartition(rng.random((m, size)), sample - 1, axis=1)[:, :sample] if sample < size else np.tile(np.arange(size), (m, 1))
        best, best_feature, best_cut = np.zeros(m), np.zeros(m, np.int64), np.zeros(m, np.int64)
        low = node * bins
        for k in range(sample):
            # rows by node and bin; the last row of each is where a cut can be
            v = low + flat[chosen[:, k][node] * n + at] << 9 | mark
            v.sort()
            key = v >> 9
            ends = np.flatnonzero(key[1:] != key[:-1])
            w = v & 255
            at_left, ones_left, key = np.cumsum(w)[ends], np.cumsum(np.where(v & 256, w, 0))[ends], key[ends]
            of = key // bins
            at_left -= before[of]
            at_right = own[of] - at_left
            inside = at_right > 0
            of, key, at_left, at_right = of[inside], key[inside], at_left[inside], at_right[inside]
            if not len(of):
                continue
            apart = ((ones_left[inside] - before_ones[of]) * own[of] - own_ones[of] * at_left).astype(np.float64)
            gain = apart * apart / at_left / at_right   # of gini, times what is the same all over a node
            begins = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            most = np.repeat(np.maximum.reduceat(gain, begins), np.diff(np.append(begins, len(of))))
            hits = np.flatnonzero(gain == most)
            hits = hits[np.concatenate([[True], of[hits[1:]] != of[hits[:-1]]])]
            hits = hits[gain[hits] > best[of[hits]]]
            best[of[hits]], best_feature[of[hits]], best_cut[of[hits]] = gain[hits], chosen[of[hits], k], key[hits] % bins
        split = best > 0
        if not split.any():
            break
        place = np.flatnonzero(mixed)[split]
        feature[place], cut[place], left[place] = best_feature[split], best_cut[split], first + 2 * np.arange(len(place))
        some = split[node]
        node, at, mark = node[some], at[some], mark[some]
        node = 2 * (np.cumsum(split) - 1)[node] + (flat[best_feature[node] * n + at] > best_cut[node])
        weight = mark & 255
        total = np.bincount(node, weight, 2 * len(place)).astype(np.int64)
        ones = np.bincount(node, np.where(mark & 256, weight, 0), 2 * len(place)).astype(np.int64)
    # two leaves of one decision are one, from below
    for (feature, *_), (under, _, _, total, ones) in zip(levels[-2::-1], levels[:0:-1]):
        leaf, says = (under < 0).reshape(-1, 2), (2 * ones > total).reshape(-1, 2)
        feature[np.flatnonzero(feature >= 0)[leaf.all(axis=1) & (says[:, 0] == says[:, 1])]] = -1
    feature, cut, left, total, ones = (np.concatenate(x) for x in zip(*levels))
    return feature, cut, left, ones / np.maximum(total, 1)


def votes(trees: tuple[np.ndarray, ...], roots: int, codes: np.ndarray) -> np.ndarray:
    """Per column of ``codes`` the sum of the trees' shares of class 1."""
    feature, cut, left, share = trees
    n = codes.shape[1]
    out = np.zeros(n)
    step = max(1, AT_ONCE // roots)
    for a in range(0, n, step):
        part = np.ascontiguousarray(codes[:, a:a + step])
        width, flat = part.shape[1], part.ravel()
        node = np.repeat(np.arange(roots), width)
        on = np.arange(len(node))
        while len(on):
            here = node[on]
            f = feature[here]
            inner = f >= 0
            on, here, f = on[inner], here[inner], f[inner]
            node[on] = left[here] + (flat[f * width + on % width] > cut[here])
        out[a:a + step] = share[node].reshape(roots, width).sum(axis=0)
    return out


def _binned(cuts: list[tuple[str, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            values = {c: part.column(c).to_numpy(zero_copy_only=False) for c in {c for c, _ in cuts}}
            codes = np.empty((part.num_rows, len(cuts)), np.uint8)
            for i, (c, at) in enumerate(cuts):
                codes[:, i] = np.searchsorted(at, values[c])
            fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(cuts)), part.num_rows, [None, pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("_row", "_order", "_group", "_y")), fixed.cast(pa.binary())],
                                             ["_row", "_order", "_group", "_y", "codes"])
    return run


def _grown(shared, forests: list[Forest], columns: list[list[int]], parts: list[tuple[int, int, int]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, y, group, row = shared.value
        for part in (i for batch in batches for i in batch.column(0).to_pylist()):
            fit, first, n = parts[part]
            f = forests[fit]
            learns, scored = (np.flatnonzero(np.isin(group, list(x))) for x in (f.learns, f.scores))
            known, own = codes[np.ix_(columns[fit], learns)], codes[np.ix_(columns[fit], scored)]
            out = np.zeros(len(scored))
            step = max(1, AT_ONCE // max(1, len(learns)))
            for a in range(first, first + n, step):
                rngs = [np.random.default_rng([f.seed & (1 << 64) - 1, tree]) for tree in range(a, min(a + step, first + n))]
                weights = np.stack([np.minimum(rng.poisson(1.0, len(learns)), 255).astype(np.uint8) for rng in rngs])
                out += votes(grow(known, y[learns], weights, f.depth, f.bins, rngs[0]), len(rngs), own)
            for block, a in enumerate(range(0, len(scored), BLOCK)):
                yield pa.RecordBatch.from_arrays([pa.array([fit]), pa.array([block]), pa.array([part]), pa.array([row[scored[a:a + BLOCK]].tobytes()]),
                                                  pa.array([out[a:a + BLOCK].tobytes()])], ["fit", "block", "part", "rows", "votes"])
    return run


def _added(trees: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks with the votes of all parts, in their order, to rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = np.frombuffer(r["each"][0]["rows"], np.int64)
                p = np.zeros(len(rows))
                for x in r["each"]:
                    p += np.frombuffer(x["votes"], np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), r["fit"])), pa.array(rows),
                                                  pa.array(np.clip(p / trees[r["fit"]], 0.0, 1.0))], ["_fit", "_row", "_p"])
    return run


def probabilities(table: DataFrame, forests: list[Forest], learning: list[int]) -> DataFrame:
    """``_fit`` (number of the forest), ``_row`` and ``_p``, the probability of class 1, for the rows that each of ``forests`` scores.

    ``table``: ``_row`` (a number of its own), ``_order`` (rows are drawn in this order, then by number),
    ``_group``, ``_y`` (0 or 1) and the features; it is read twice and must not change.  ``learning``: from how many rows
    each forest learns.
    """
    spark = table.sparkSession
    names = list(dict.fromkeys(c for f in forests for c in f.features))
    values = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in names]
    sets = {f.learns: n for f, n in zip(forests, learning)}
    sample = table.where(F.col("_group").isin(sorted(frozenset.union(*sets))))
    if min(sets.values()) > ROWS_FOR_BINS:
        sample = sample.sample(ROWS_FOR_BINS / min(sets.values()), forests[0].seed)
    sample = sample.select("_group", *values).toArrow()
    of_group = sample.column("_group").to_numpy()
    cuts, number = [], {}
    for f in forests:
        inside = np.isin(of_group, list(f.learns))
        for c in f.features:
            if (c, f.learns, f.bins) not in number:
                number[c, f.learns, f.bins] = len(cuts)
                cuts.append((c, thresholds(sample.column(c).to_numpy()[inside], f.bins)))
    columns = [[number[c, f.learns, f.bins] for c in f.features] for f in forests]
    binned = (table.select("_row", "_order", "_group", "_y", *values)
              .mapInArrow(_binned(cuts), "_row long, _order long, _group int, _y int, codes binary").toArrow())
    row, order, group, y = (binned.column(c).to_numpy() for c in ("_row", "_order", "_group", "_y"))
    turn = np.lexsort([row, order])
    raw = pa.concat_arrays(binned.column("codes").chunks).cast(pa.large_binary())
    begin = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset]
    codes = np.frombuffer(raw.buffers()[2], np.uint8)[begin:begin + len(row) * len(cuts)].reshape(-1, len(cuts))
    shared = spark.sparkContext.broadcast((np.ascontiguousarray(codes[turn].T), y[turn].astype(np.uint8), group[turn], row[turn]))
    del binned, raw, codes
    parts = []
    for fit, (f, n) in enumerate(zip(forests, learning)):
        size = max(1, min(f.trees, ROW_TREES // max(1, n)))
        parts += [(fit, first, min(size, f.trees - first)) for first in range(0, f.trees, size)]
    path = f"{checkpoint_dir(spark).rstrip('/')}/forests-{uuid.uuid4().hex}"
    blocks = (spark.range(0, len(parts), 1, len(parts))
              .mapInArrow(_grown(shared, forests, columns, parts), "fit long, block long, part long, rows binary, votes binary"))
    (blocks.groupBy("fit", "block").agg(F.array_sort(F.collect_list(F.struct("part", "rows", "votes"))).alias("each"))
     .mapInArrow(_added([f.trees for f in forests]), "_fit long, _row long, _p double").write.parquet(path))
    shared.destroy()
    return spark.read.parquet(path)
