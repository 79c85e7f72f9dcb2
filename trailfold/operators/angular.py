"""Which tiles of a pool can hold a k-th nearest neighbour by cosine distance.

The angle between two directions obeys the triangle inequality (a zero vector,
at distance 1 from everything, is a point at a right angle to all others, itself
included, which keeps it true).  So with centres ``c`` from a bounded sample:

* a pool row belongs to its nearest centre and there to a *ring* of width
  ``pi / RINGS`` by its angle to it: at most ``CENTRES * RINGS`` tiles, each with
  its row count and its least and largest angle, whatever the size of the pool;
* a target at angle ``a`` from a centre is at least ``max(a - hi, lo - a)`` and at
  most ``a + hi`` from every row of a tile ``[lo, hi]``: the first decides whether
  the tile can matter, the second bounds the k-th neighbour before any is seen.

Everything here runs on blocks of rows inside tasks; the driver sees the sample
and the tile table only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CENTRES, RINGS = 64, 64
SAMPLE_ROWS = 4096      # pool rows, by hash of their id, that the centres are chosen from
BLOCK = 1024            # targets whose bounds to all tiles are in memory at a time
#: Distances are compared to 12 digits: a tie there is an angle of at most sqrt(2e-12) apart.
SLACK = 1e-5


class Tiles(NamedTuple):
    """One row a tile: its centre, its angles, its rows and the parts of bounded size that it is split into."""
    centres: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    parts: np.ndarray


def unit(vectors) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay zero, rows with a NaN or an infinity become NaN."""
    a = np.vstack(list(vectors)).astype(np.float64)
    with np.errstate(invalid="ignore"):
        n = np.linalg.norm(a, axis=1, keepdims=True)
        out = np.divide(a, n, out=np.zeros_like(a), where=n > 0)
    out[~np.isfinite(a).all(axis=1)] = np.nan
    return out


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def choose_centres(pool: DataFrame, number: int = CENTRES, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Centres from a bounded sample: each next one is farthest from those before; then moved to their cells' means."""
    sample = unit([r["vec"] for r in pool.orderBy(F.xxhash64("pid"), "pid").limit(sample_rows).select("vec").collect()])
    sample = sample[np.isfinite(sample).all(axis=1)]
    if not len(sample):
        return np.zeros((1, 1))
    chosen, nearest = [0], angles(sample, sample[:1])[:, 0]
    while len(chosen) < number and nearest.max() > SLACK:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, angles(sample, sample[chosen[-1:]])[:, 0])
    centres = sample[chosen]
    for _ in range(3):
        own = angles(sample, centres).argmin(axis=1)
        means = np.zeros_like(centres)
        np.add.at(means, own, sample)
        centres = unit(means)
    return centres


def locate(pool: DataFrame, centres: np.ndarray, kind: str) -> DataFrame:
    """``pid, vec, cell, ring, angle`` of the pool rows that have a direction (no NaN, no infinity)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            a = unit(b["vec"])
            fine = np.isfinite(a).all(axis=1)
            b, a = b[fine], a[fine]
            to_all = angles(a, centres) if len(a) else np.zeros((0, len(centres)))
            own = to_all.argmin(axis=1)
            angle = to_all[np.arange(len(own)), own]
            yield b.assign(cell=own.astype("int32"), ring=np.minimum(angle / np.pi * RINGS, RINGS - 1).astype("int32"), angle=angle)
    return pool.mapInPandas(run, f"pid {kind}, vec array<double>, cell int, ring int, angle double")


def tile_table(located: DataFrame, centres: np.ndarray, tile_rows: int) -> tuple[Tiles, DataFrame]:
    """The tiles (at most ``CENTRES * RINGS`` rows), and a DataFrame ``cell, ring, tile, parts`` of what is in which.

    Neighbouring rings of a centre are one tile as long as they hold ``tile_rows`` rows together: a target is sent to
    each tile that it visits, so there are no more tiles than the pool needs.
    """
    found = sorted(located.groupBy("cell", "ring").agg(F.min("angle").alias("low"), F.max("angle").alias("high"),
                                                       F.count(F.lit(1)).alias("rows")).collect())
    groups: list[list] = []
    for r in found:
        last = groups[-1] if groups else None
        if last and last[-1]["cell"] == r["cell"] and sum(x["rows"] for x in last) + r["rows"] <= tile_rows:
            last.append(r)
        else:
            groups.append([r])
    rows = [sum(r["rows"] for r in g) for g in groups]
    parts = [-(-n // tile_rows) for n in rows]
    tiles = Tiles(centres, np.array([g[0]["cell"] for g in groups], int), np.array([g[0]["low"] for g in groups]),
                  np.array([g[-1]["high"] for g in groups]), np.array(rows, int), np.array(parts, int))
    frame = located.sparkSession.createDataFrame(
        [(r["cell"], r["ring"], i, parts[i]) for i, g in enumerate(groups) for r in g], "cell int, ring int, tile int, parts int")
    return tiles, frame


def bounds(vectors: np.ndarray, tiles: Tiles, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per target and tile the least angle to a row of it; per target a bound on the angle of its k-th neighbour.

    The nearest tiles by their largest angle that hold ``k + 1`` rows together (one may be the target itself) hold
    ``k`` neighbours; fewer rows in all give no bound.
    """
    a = angles(vectors, tiles.centres)[:, tiles.cell]
    least = np.maximum(np.maximum(a - tiles.high, tiles.low - a), 0.0)
    most = a + tiles.high
    order = np.argsort(most, axis=1)
    enough = np.cumsum(tiles.rows[order], axis=1) > k
    at = enough.argmax(axis=1)
    rows = np.arange(len(a))
    return least, np.where(enough[rows, at], most[rows, order[rows, at]], np.inf)


def homes(targets: DataFrame, tiles: Tiles, k: int, kind: str) -> DataFrame:
    """``tid, vec, home, bound``: the tile that is visited first, and what is known of the k-th neighbour before."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for lo in range(0, len(whole), BLOCK):
                b = whole.iloc[lo:lo + BLOCK]
                a = unit(b["vec"])
                fine = np.isfinite(a).all(axis=1)
                b, a = b[fine], a[fine]
                if len(a):
                    least, bound = bounds(a, tiles, k)
                    yield b.assign(home=least.argmin(axis=1).astype("int32"), bound=bound)
    return targets.mapInPandas(run, f"tid {kind}, vec array<double>, home int, bound double")


def tiles_to_visit(targets: DataFrame, tiles: Tiles, k: int) -> DataFrame:
    """``targets`` with ``tiles``: the tiles that may hold a row within ``bound``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for lo in range(0, len(whole), BLOCK):
                b = whole.iloc[lo:lo + BLOCK]
                least, _ = bounds(unit(b["vec"]), tiles, k)
                near = least <= b["bound"].to_numpy()[:, None] + SLACK
                yield b.assign(tiles=[np.flatnonzero(row).astype("int32") for row in near])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in targets.schema.fields]
    return targets.mapInPandas(run, ", ".join([*fields, "tiles array<int>"]))


def blocks_of_homes(counts: dict[int, int], tile_rows: int) -> list[tuple[int, int, int]]:
    """``(home, first block, blocks)``: neighbouring homes share a block of up to ``tile_rows`` targets, larger ones have several."""
    out, block, filled = [], 0, 0
    for home, n in sorted(counts.items()):
        if filled and filled + n > tile_rows:
            block, filled = block + 1, 0
        own = -(-n // tile_rows)
        out.append((home, block, own))
        if own > 1:
            block, filled = block + own, 0
        else:
            filled += n
    return out
