"""Quality classification by co-training of a text view and a metadata view.

Two logistic models look at different columns: the text view at hashed words
and at the make-up of the text, the metadata view at source, language and
length.  Over rounds each names the unlabelled documents it is surest of, and
these pseudo-labels join the other one's training rows.  Each view is then
calibrated on labelled rows that no round has seen, and the calibrated views
are weighted together into one probability for every document.

Fitting uses a bounded sample (``labelled`` labelled and ``pool`` other rows,
those with the smallest hash of their id), whose feature vectors of fixed
width are gathered on the driver.  Scoring reads all rows whole, map-only.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailfold.llm import words as W
from trailfold.llm.common import text_bytes, text_slices

LABELLED, POOL, ROUNDS, SURE = 6000, 6000, 4, 0.95
#: Documents that score less are rejected.
KEEP = 0.5
BUCKETS, META = 1024, 128
_KIND = np.full(256, 6, np.int64)
_KIND[list(range(97, 123))] = 0
_KIND[list(range(65, 91))] = 1
_KIND[list(range(48, 58))] = 2
_KIND[list(b" \t\r\v\f")] = 3
_KIND[10] = 4
_KIND[list(b".,;:'\"-()!?")] = 5
_KIND[128:] = 7
STYLE = 8 + 6


def text_view(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text: hashed words of unit length, then the make-up of the text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((n, BUCKETS + STYLE), np.float32)
    if not n:
        return out
    kinds = np.bincount(np.repeat(np.arange(n) * 8, size) + _KIND[data], minlength=8 * n).reshape(n, 8)
    starts, ends, text = W.spans(data, offsets)
    hashed = W.hashes(data, starts, ends)
    words = np.bincount(text, minlength=n)
    bags = np.bincount(text * BUCKETS + (hashed >> np.uint64(40)).astype(np.int64) % BUCKETS,
                       minlength=n * BUCKETS).reshape(n, BUCKETS)
    spread = np.sqrt(bags)
    out[:, :BUCKETS] = spread / np.maximum(np.sqrt((spread ** 2).sum(axis=1, keepdims=True)), 1)
    out[:, BUCKETS:BUCKETS + 8] = kinds / np.maximum(size, 1)[:, None]
    different = text[np.unique(W.mix(hashed + text.astype(np.uint64)), return_index=True)[1]]
    style = out[:, BUCKETS + 8:]
    style[:, 0] = np.log1p(words) / 10
    style[:, 1] = np.bincount(different, minlength=n) / np.maximum(words, 1)
    style[:, 2] = size / np.maximum(words, 1) / 10
    # words that end in a sign other than a stop or comma
    tail = data[ends - 1] if len(ends) else data[:0]
    style[:, 3] = np.bincount(text, _KIND[tail] == 6, n) / np.maximum(words, 1)
    style[:, 4] = _repeated_lines(data, offsets, n)
    style[:, 5] = 1
    return out


def _repeated_lines(data: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Share of each text's lines that stand in it before."""
    cut = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
    starts, ends = cut[:-1], cut[1:]
    ends = ends - (data[ends - 1] == 10) if len(ends) else ends
    full = ends > starts
    starts, ends = starts[full], ends[full]
    if not len(starts):
        return np.zeros(n)
    text = np.searchsorted(offsets, starts, side="right") - 1
    pairs = W.mix(W.hashes(data, starts, ends) + text.astype(np.uint64))
    different = np.bincount(text[np.unique(pairs, return_index=True)[1]], minlength=n)
    lines = np.bincount(text, minlength=n)
    return (lines - different) / np.maximum(lines, 1)


def meta_view(columns: dict[str, list], sizes: list) -> np.ndarray:
    """One row per document: hashed values of the metadata columns, and the length."""
    n = len(sizes)
    out = np.zeros((n, META + 3), np.float32)
    for name, values in columns.items():
        for i, v in enumerate(values):
            out[i, zlib.crc32(f"{name}={v}".encode()) % META] = 1
    length = np.array([math.log1p(max(0, s)) / 10 if s is not None else 0 for s in sizes], np.float32)
    out[:, META], out[:, META + 1], out[:, META + 2] = length, length ** 2, 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 250, penalty: float = 1e-4) -> np.ndarray:
    """Weights of a logistic model by accelerated gradient steps; the last column is the intercept."""
    x, y, weight = (a.astype(np.float32) for a in (x, y, weight))
    w = np.zeros(x.shape[1], np.float32)
    ahead = w.copy()
    total = weight.sum()
    rate = np.float32(4 / max(1e-9, float(((x ** 2).sum(axis=1) * weight).sum() / total)))
    ridge = np.full(x.shape[1], penalty, np.float32)
    ridge[-1] = 0
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        grad = x.T @ ((p - y) * weight) / total + ridge * ahead
        after = ahead - rate * grad
        ahead = after + np.float32(t / (t + 3)) * (after - w)
        w = after
    return w.astype(np.float64)


@dataclass
class QualityModel:
    """Weights of both views, and of their calibrated combination."""
    text: np.ndarray
    meta: np.ndarray
    mixed: np.ndarray
    base: float | None = None
    rounds: list[tuple[int, int]] = field(default_factory=list)

    def views(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return np.stack([np.clip(text @ self.text, -20, 20), np.clip(meta @ self.meta, -20, 20), np.ones(len(text))], 1)

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.base is not None:
            return np.full(len(text), self.base)
        return 1 / (1 + np.exp(-self.views(text, meta) @ self.mixed))


def co_train(text: np.ndarray, meta: np.ndarray, label: np.ndarray, calibrate: np.ndarray, rounds: int = ROUNDS,
             sure: float = SURE) -> QualityModel:
    """``label``: 0 or 1, -1 for the pool; ``calibrate``: labelled rows kept out of training."""
    known = label >= 0
    learn = known & ~calibrate
    empty = QualityModel(np.zeros(text.shape[1]), np.zeros(meta.shape[1]), np.zeros(3))
    if len(set(label[learn])) < 2:
        # nothing to tell apart: the labels' mean, or one half
        empty.base = float(label[known].mean()) if known.any() else 0.5
        return empty
    views = [text, meta]
    given = [np.where(learn, label, -1), np.where(learn, label, -1)]
    pool = np.flatnonzero(~known)
    share = label[learn].mean()
    model = empty
    for turn in range(rounds + 1):
        fitted = [logistic(x[rows], g[rows].astype(float), np.where(learn[rows], 1.0, 0.3))
                  for x, g in zip(views, given) for rows in [np.flatnonzero(g >= 0)]]
        model.text, model.meta = fitted
        if turn == rounds:
            break
        # each view labels for the other what it is sure of, in the classes' shares
        most = max(1, len(pool) // (2 * rounds))
        for mine, other in ((0, 1), (1, 0)):
            open_rows = pool[given[other][pool] < 0]
            p = 1 / (1 + np.exp(-np.clip(views[mine][open_rows] @ fitted[mine], -30, 30)))
            for value, chance, number in ((1, p, most * share), (0, 1 - p, most * (1 - share))):
                best = np.argsort(-chance, kind="stable")[:max(1, int(number))]
                given[other][open_rows[best[chance[best] >= sure]]] = value
        model.rounds.append(tuple(int((g[pool] >= 0).sum()) for g in given))
    held = np.flatnonzero(calibrate & known)
    if len(set(label[held])) < 2:
        held = np.flatnonzero(learn)
    both = model.views(text[held], meta[held])
    scale = np.maximum(both.std(axis=0), 1e-6)
    scale[2] = 1
    # Platt scaling of both views at once; a view that tells nothing gets no weight
    model.mixed = logistic(both / scale, label[held].astype(float), np.ones(len(held)), penalty=1e-3) / scale
    return model


def _features(docs: DataFrame, id_col: str, text_col: str, meta_cols: tuple[str, ...], size_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"),
                       *[docs[c].cast("string").alias(f"m{i}") for i, c in enumerate(meta_cols)],
                       docs[size_col].cast("long").alias("size"))


def _both_views(part: pa.RecordBatch, meta_cols: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    metas = {c: part.column(f"m{i}").to_pylist() for i, c in enumerate(meta_cols)}
    return text_view(*text_bytes(part.column("text"))), meta_view(metas, part.column("size").to_pylist())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        meta_cols: tuple[str, ...] = ("source", "lang"), size_col: str = "n_chars", labelled: int = LABELLED,
        pool: int = POOL, rounds: int = ROUNDS) -> QualityModel:
    """Co-train on a bounded sample.

    Rows with null ids or labels are not learned from; an id labelled twice
    counts with its largest label; where labels are missing or all alike,
    every document scores their mean (one half without labels).
    """
    truth = (labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label"))
             .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1)).groupBy("id").agg(F.max("label").alias("label")))
    ids = docs.select(docs[id_col].alias("id")).filter(F.col("id").isNotNull()).distinct()
    told = ids.join(truth, "id", "left")
    smallest = [F.xxhash64("id"), "id"]
    some = told.filter(F.col("label").isNotNull()).orderBy(*smallest).limit(labelled)
    rest = told.filter(F.col("label").isNull()).orderBy(*smallest).limit(pool)
    chosen = some.unionByName(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            text, meta = _both_views(part, meta_cols)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("label"), pa.array([r.tobytes() for r in text.astype(np.float16)], pa.binary()),
                 pa.array([r.tobytes() for r in meta], pa.binary())], ["id", "label", "text", "meta"])

    # at most labelled + pool rows: a bounded side, and bounded vectors on the driver
    sample = _features(docs, id_col, text_col, meta_cols, size_col).join(F.broadcast(chosen), "id")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = sample.mapInArrow(run, f"id {kind}, label int, text binary, meta binary").orderBy("id").limit(
        2 * (labelled + pool)).collect()
    if not rows:
        return QualityModel(np.zeros(BUCKETS + STYLE), np.zeros(META + 3), np.zeros(3), base=0.5)
    text = np.stack([np.frombuffer(r["text"], np.float16) for r in rows]).astype(np.float32)
    meta = np.stack([np.frombuffer(r["meta"], np.float32) for r in rows])
    label = np.array([-1 if r["label"] is None else r["label"] for r in rows])
    held = np.array([zlib.crc32(str(r["id"]).encode()) % 5 == 0 for r in rows])
    return co_train(text, meta, label, held & (label >= 0), rounds)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text",
          meta_cols: tuple[str, ...] = ("source", "lang"), size_col: str = "n_chars", out: str = "score",
          with_views: bool = False) -> DataFrame:
    """All columns of ``docs`` (but one named ``out``) and the probability of good quality.

    Every row is scored, repeated rows alike; null text is empty text, null
    metadata are values of their own.
    """
    docs = docs.drop(out, *(("text_view", "meta_view") if with_views else ()))
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = {c: n for c, n in zip(docs.columns, names)}
    renamed = docs.select(*[docs[c].alias(n) for c, n in place.items()],
                          *[docs[c].cast("string").alias(f"m{i}") for i, c in enumerate(meta_cols)],
                          docs[size_col].cast("long").alias("size"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_name = place[text_col]
    added = [out, "text_view", "meta_view"] if with_views else [out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in text_slices(batches, text_name):
            metas = {c: part.column(f"m{i}").to_pylist() for i, c in enumerate(meta_cols)}
            text = text_view(*text_bytes(part.column(text_name)))
            meta = meta_view(metas, part.column("size").to_pylist())
            columns = [pa.array(m.score(text, meta), pa.float64())]
            if with_views:
                columns += [pa.array(1 / (1 + np.exp(-v)), pa.float64()) for v in m.views(text, meta)[:, :2].T]
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *columns],
                                             [*names, *[f"a{i}" for i in range(len(columns))]])

    kinds = [f.dataType.simpleString() for f in docs.schema.fields]
    schema = ", ".join([*[f"{n} {k}" for n, k in zip(names, kinds)], *[f"a{i} double" for i in range(len(added))]])
    done = renamed.mapInArrow(run, schema)
    return done.select(*[F.col(n).alias(c) for c, n in place.items()],
                       *[F.col(f"a{i}").alias(c) for i, c in enumerate(added)])
