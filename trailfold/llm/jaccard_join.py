"""Exact Jaccard join of documents' word shingles as a metric-space join.

The Jaccard distance is a metric, but most documents lie at distance 1 from
each other, where no pivot tells them apart.  So the space is cut in two steps:

1. *Projections.*  The universe of shingles is cut into ``m`` parts.  Two
   documents within the threshold differ in at most ``D`` shingles, so of
   ``m > D`` parts they agree in one at least: there, their projections are one
   point.  ``m`` follows from the sizes, on a grid that both sizes of a pair
   agree on.  In a point, pairs that a lower bound of their distance (the L1
   distance of coarse counts of their shingles) already parts are passed over;
   the others chain documents to clusters, and no link leaves a cluster.
2. *Voronoi regions* inside a cluster: pivots are drawn, every document goes
   to the region of its nearest pivot, and to each other region whose pivot is
   at most twice the threshold farther away — by the triangle inequality no
   pair is then parted.  Regions are cut again in the same way while that
   helps, and joined exactly.  Clusters too large for a task are cut by Spark
   jobs, into pairs of blocks of bounded size or, where these were many, into
   the documents that agree in one projection and these into Voronoi regions; small ones within a task.  A region that pivots do not cut
   (all distances alike) is joined in pairs of blocks of bounded size.  Before
   that, each document of a large cluster is measured against one it shares
   most projections with: what these links connect needs no further pair, so
   projections whose documents are all connected are left out.

Equal sets are one class from the start, and a region yields no list of pairs
but the edges of a spanning forest of its links.  Sets of 64-bit shingle hashes
stand for sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailfold.llm import words as W
from trailfold.llm.common import fresh, remove, rows_per_batch, saved, shuffle_width, text_bytes, text_slices
from trailfold.llm.components import components

#: A region joined in one task: documents and shingles at most.
REGION, REGION_SHINGLES = 256, 1_500_000
PIVOTS, TASK_PIVOTS, DIRECT = 6, 8, 48
#: Times that a document of a large cluster is measured against one before its regions are joined.
ROUNDS = 3
#: A cluster of more blocks is cut by its points: a document is in as many pairs of blocks, or in as many points as it has.
BLOCKS = 24
#: Voronoi regions may hold so many copies of a document on average.
COPIES = 2
GRID = 1.5
#: Rows with a text, and with sets, that Python gets at once.
TEXTS_AT_ONCE, SETS_AT_ONCE = 1500, 400
#: Sets that a task remembers to have sent already.
SEEN = 1_000_000
#: Bits of the filter of clustered sets, in 64-bit words.
FILTER_WORDS = 1 << 17
#: Bits of a point that name its grid value.
GRID_BITS = np.uint64(127)


class Threshold:
    """Similarity of at least ``num / den``, in whole numbers."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("a similarity threshold over 0, at most 1")
        self.num, self.den = num, den
        self.eps = 1 - num / den
        grid = [2]
        while grid[-1] < 1 << 40:
            grid.append(max(grid[-1] + 1, int(grid[-1] * GRID)))
        self.grid = np.array(grid)

    def links(self, both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.den * both >= self.num * (a + b - both)

    def most(self, total: int) -> int:
        """Shingles in which two sets of ``total`` together may differ."""
        return total * (self.den - self.num) // (self.den + self.num)

    def parts(self, n: int) -> list[tuple[int, int]]:
        """The numbers of parts that sets of ``n`` meet partners on, each with the most differences there."""
        if not n:
            return []
        low = self.most(n + -(-self.num * n // self.den))
        high = self.most(n + self.den * n // self.num)
        if not high:
            return []
        first, last = np.searchsorted(self.grid, [self.needed(max(1, low)), self.needed(high)])
        out = []
        for m in self.grid[first:last + 1].tolist():
            # the most differences of a pair that meets on m parts
            most = min(high, m * 6 // 7)
            while self.needed(most) > m:
                most -= 1
            out.append((m, most))
        return out

    @staticmethod
    def needed(differences: int) -> int:
        """Parts for that many differences: more than one is left over, so that parts empty by chance need no key."""
        return differences + 3 + differences // 6


def set_id(found: np.ndarray) -> int:
    """A hash of a set of hashes, as a signed long."""
    total = W.mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True)
    size = np.array([len(found)], np.uint64) * np.uint64(0x2545F4914F6CDD1D)
    return int(W.mix(total + size)[0].astype(np.int64))


def projections(found: np.ndarray, threshold: Threshold) -> np.ndarray:
    """Keys of a sorted set's projections onto the first parts of its grid values."""
    return agreements(found, threshold)[0]


def agreements(found: np.ndarray, threshold: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a sorted set's projections, and in how many keys of its grid value the set has to agree with a partner.

    Of any ``needed(D)`` parts a pair that differs in ``D`` shingles at most
    agrees in all but ``D``, so the parts beyond are not used, and a set that
    shares fewer of its keys than ``needed(D) - D`` with others has no partner
    on that grid value.  An empty projection is a key only where a pair could
    agree in nothing else: where as many of the used ones are empty as are left
    over; elsewhere the empty ones are taken off the number.  The lowest bits
    of a key name its grid value.
    """
    keys, least = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(W.mix(found ^ np.uint64(0x14057B7EF767814F)))]).astype(np.uint64)
    for m, most in threshold.parts(len(found)):
        edges = (np.arange(1, m, dtype=object) * (1 << 64) // m).astype(np.uint64) if m < 4096 else \
            (np.arange(1, m, dtype=np.uint64) * np.uint64((1 << 64) // m))
        at = np.concatenate([[0], np.searchsorted(found, edges), [len(found)]])
        used = min(m, threshold.needed(most))
        at = at[:used + 1]
        size = np.diff(at)
        part = np.arange(used, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.full(used, m, np.uint64) * np.uint64(0x3F58476D1CE4E5B9)
        key = W.mix(sums[at[1:]] - sums[at[:-1]] + part)
        key = key & ~GRID_BITS | np.uint64(np.searchsorted(threshold.grid, m)) & GRID_BITS
        empty, spare = int((size == 0).sum()), used - most
        keys.append(key if empty >= spare else key[size > 0])
        least.append(np.full(len(keys[-1]), max(1, spare if empty >= spare else spare - empty), np.int64))
    return np.concatenate(keys), np.concatenate(least)


def sketch(found: np.ndarray) -> bytes:
    """Counts of a set's hashes in equal ranges, 4 to 8 on average, in small sets 1 to 2 (255 stands for more)."""
    bits = _bits(len(found))
    place = (found >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(found), np.int64)
    return np.minimum(np.bincount(place, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _bits(n: int) -> int:
    return max(0, (max(1, n) // (1 if n <= 128 else 4)).bit_length() - 1)


def may_link(sizes: list[int], raws: list[bytes], threshold: Threshold) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (places) that the sketches' distance does not part.

    Sketches are compared at the coarsest one's ranges.  Each range's counts
    differ by no more than the sets do there, so the sum is a lower bound.
    """
    least = min(map(len, raws))
    # sums of capped counts are capped too, which only lowers the bound
    wide = [np.minimum(np.frombuffer(r, np.uint8).reshape(least, -1).sum(axis=1, dtype=np.int32), 255) for r in raws]
    if len(raws) == 2:
        apart = int(np.abs(wide[0] - wide[1]).sum())
        return [(0, 1)] if apart <= threshold.most(sizes[0] + sizes[1]) else []
    counts, n = np.stack(wide), np.array(sizes)
    root = list(range(len(n)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    forest = []
    for i in range(len(n) - 1):
        apart = np.abs(counts[i + 1:] - counts[i]).sum(axis=1)
        most = (n[i + 1:] + n[i]) * (threshold.den - threshold.num) // (threshold.den + threshold.num)
        for j in (np.flatnonzero(apart <= most) + i + 1).tolist():
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                forest.append((i, j))
    return forest


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in text_slices(batches, "text"):
        yield part, W.shingle_sets(*text_bytes(part.column("text")), k)


# ------------------------------------------------------------------ joining a region

def overlaps(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets of ``rows`` with those of ``columns``, in bounded memory."""
    out = np.zeros((len(rows), len(columns)))
    used = np.unique(np.concatenate([rows, columns]))
    flat = np.concatenate([sets[i] for i in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(first) - 1
    # what only one set has is in no intersection
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    r, c = np.searchsorted(used, rows), np.searchsorted(used, columns)
    width = max(256, (1 << 22) // max(1, len(used)))
    total = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, total, width):
        i, j = np.searchsorted(column, [a, a + width])
        dense = np.zeros((len(used), min(width, total - a)), np.float32)
        dense[owner[i:j], column[i:j] - a] = 1
        out += dense[r] @ dense[c].T
    return out


def join_region(sets: list[np.ndarray], threshold: Threshold, seed: int = 0) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets``, as pairs of places."""
    size = np.array([len(s) for s in sets], np.float64)
    root = np.arange(len(sets))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    forest: list[tuple[int, int]] = []

    def link(a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                forest.append((i, j))

    rng = np.random.default_rng(seed)
    todo = [np.arange(len(sets))]
    while todo:
        own = todo.pop()
        if len(own) > DIRECT:
            pivots = np.sort(rng.choice(own, TASK_PIVOTS, replace=False))
            both = overlaps(sets, own, pivots)
            union = size[own][:, None] + size[pivots] - both
            i, j = np.nonzero(threshold.links(both, size[own][:, None], size[pivots]))
            link(own[i], pivots[j])
            regions = voronoi(1 - both / union, threshold.eps)
            cells = [own[inside] for inside in regions.T if inside.any()]
            if max(len(c) for c in cells) <= 0.7 * len(own):
                todo += cells
                continue
        both = overlaps(sets, own, own)
        i, j = np.nonzero(np.triu(threshold.links(both, size[own][:, None], size[own]), 1))
        link(own[i], own[j])
    return forest


def voronoi(distance: np.ndarray, eps: float) -> np.ndarray:
    """Which regions (columns) each document (row) goes to: its nearest pivot's, and those within the window."""
    return distance <= distance.min(axis=1, keepdims=True) + 2 * eps + 1e-9


# ------------------------------------------------------------------ the join

def near_duplicates(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` and ``class_id``.

    Words are what stands between ASCII white space, A-Z taken as a-z; the set
    of a text are its runs of ``k`` words, with fewer words the whole sequence.
    Documents are linked from a similarity of ``num / den``; the component is
    named by its smallest id.  Rows with equal sets share their class_id.

    A null text or one without words has the empty set, is linked with nothing
    and is its own component.  Repeated rows fall into one class, one row each
    in the result.  A null id takes part and gets its component's smallest id,
    null if there is none.  Other columns are not read; no rows give no rows.
    """
    done = rows_with_groups(docs, k, num, den, id_col, text_col)
    return done.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                       F.coalesce("component_id", "id").alias("component_id"), F.col("class").alias("class_id"))


def rows_with_groups(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """Per row of ``docs``: id, text_key, n, class, group (of classes that are linked) and the smallest id of the group.

    ``group`` is null for the empty set, ``component_id`` where the group is a single row.
    """
    threshold = Threshold(num, den)
    id_kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(docs[id_col].alias("id"), text_key(docs[text_col]).alias("text_key"), docs[text_col].alias("text"))
    only_text = texts.select("text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, k):
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("text_key"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
                 pa.array([sketch(s) for s in sets], pa.binary())], ["id", "text_key", "n", "class", "sketch"])

    with rows_per_batch(docs.sparkSession, TEXTS_AT_ONCE):
        classed = saved(texts.mapInArrow(describe, f"id {id_kind}, text_key long, n long, class long, sketch binary"))
    classes = classed.filter(F.col("class").isNotNull()).select(F.col("class").alias("node"), "n", "sketch").dropDuplicates(["node"])
    links = links_of(only_text, classes, k, threshold)
    classed = classed.drop("sketch")
    linked = saved(components(links)) if links is not None else None
    if linked is not None:
        grouped = classed.join(linked.withColumnRenamed("node", "class"), "class", "left")
    else:
        grouped = classed.withColumn("component", F.lit(None).cast("long"))
    grouped = grouped.select("id", "text_key", "n", "class", F.coalesce("component", "class").alias("group"))
    # only groups of several rows have another component than the row itself
    named = saved(grouped.filter(F.col("group").isNotNull()).groupBy("group")
                  .agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("rows"))
                  .filter(F.col("rows") > 1).select("group", "component_id"))
    return grouped.join(named, "group", "left")


def links_of(texts: DataFrame, sketches: DataFrame, k: int, threshold: Threshold) -> DataFrame | None:
    """Edges (a, b) between classes, a spanning forest of all links between different sets; None without any.

    ``sketches``: (node, n, sketch) of every class.
    """
    width = shuffle_width(texts.sparkSession)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _sets(batches, k):
            keys, owners, needs = [], [], []
            for s in sets:
                if not len(s) or (name := set_id(s)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(name)
                found, least = agreements(s, threshold)
                keys.append(found)
                owners.append(np.full(len(found), name, np.int64))
                needs.append(least)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(owners)),
                                                  pa.array(np.concatenate(needs), pa.int32())], ["point", "node", "least"])

    def shared_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by point and node: the different rows of points that hold several nodes, batch by batch."""
        held = np.zeros((3, 0), np.int64)      # the last row, if nothing is known to share its point yet
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.concatenate([held, np.stack([b.column(c).to_numpy() for c in ("point", "node", "least")])], axis=1)
            point, node, _ = rows
            same = np.concatenate([[last is not None and not held.size and last[0] == point[0]], point[1:] == point[:-1]])
            again = np.concatenate([[bool(same[0]) and last[1] == node[0]], (node[1:] == node[:-1]) & same[1:]])
            last = rows[:, -1]
            rows, same = rows[:, ~again], same[~again]
            open_end = bool(rows.shape[1]) and not same[-1]
            held = rows[:, -1:] if open_end else np.zeros((3, 0), np.int64)
            keep = same | np.concatenate([same[1:], [False]])
            yield pa.RecordBatch.from_arrays([pa.array(rows[0][keep]), pa.array(rows[1][keep]), pa.array(rows[2][keep], pa.int32())],
                                             ["point", "node", "least"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by point: edges between the nodes of a point that may be linked, a spanning forest of them."""
        point, head, nodes = None, 0, {}
        edges: list[tuple[int, int]] = []

        def close() -> None:
            if 1 < len(nodes) <= REGION:
                names = list(nodes)
                edges.extend((names[i], names[j]) for i, j in may_link([nodes[x][0] for x in names], [nodes[x][1] for x in names], threshold))

        for b in batches:
            for p, node, n, raw in zip(b.column("point").to_pylist(), b.column("node").to_pylist(), b.column("n").to_pylist(),
                                       b.column("sketch").to_pylist()):
                if p != point:
                    close()
                    point, head, nodes = p, node, {}
                if len(nodes) < REGION:
                    nodes[node] = (n, raw)
                    continue
                # too many to compare: all are chained to the first
                if len(nodes) == REGION:
                    edges.extend((x, head) for x in nodes if x != head)
                    nodes[None] = (0, b"")
                edges.append((node, head))
            if edges:
                pairs = np.unique(np.array(edges, np.int64), axis=0)
                edges.clear()
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
        close()
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges)], ["a", "b"])

    keyed = texts.mapInArrow(project, "point long, node long, least int")
    points = saved(keyed.repartition(width, "point").sortWithinPartitions("point", "node")
                   .mapInArrow(shared_points, "point long, node long, least int"))
    # shuffle files go as soon as they are read: those of the points are most of what the join writes
    del keyed
    remove(texts.sparkSession, [])
    # a set goes on only in points of grid values where it shares as many points as a partner would
    own = Window.partitionBy("node", F.col("point").bitwiseAND(F.lit(int(GRID_BITS))))
    points = (points.repartition(width, "node").withColumn("shared", F.count(F.lit(1)).over(own))
              .filter(F.col("shared") >= F.col("least")).select("point", "node"))
    chained = (points.join(sketches, "node").select("point", "node", "n", "sketch")
               .repartition(width, "point").sortWithinPartitions("point").mapInArrow(chain, "a long, b long"))
    clusters = saved(components(chained))
    del points, chained
    remove(texts.sparkSession, [])
    if clusters.isEmpty():
        return None

    # a filter of bounded size lets the scan send the clustered sets and few others
    at = F.pmod(F.xxhash64("node"), F.lit(64 * FILTER_WORDS))
    words = (clusters.select(F.floor(at / 64).cast("int").alias("w"), (at % 64).cast("int").alias("bit"))
             .groupBy("w").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).alias("bits")))
    bits = np.zeros(FILTER_WORDS, np.int64)
    for r in words.collect():
        bits[r["w"]] = r["bits"]
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _sets(batches, k):
            rows = []
            for s in sets:
                if not len(s) or (name := set_id(s)) in seen:
                    continue
                place = _xxhash64(name) % (64 * FILTER_WORDS)
                if int(shared.value[place >> 6]) >> (place & 63) & 1:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(name)
                    rows.append((name, len(s), s.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                                  pa.array([r[2] for r in rows], pa.binary())], ["node", "n", "found"])

    sent = texts.mapInArrow(gather, "node long, n long, found binary")
    with rows_per_batch(texts.sparkSession, TEXTS_AT_ONCE):
        sets = saved(sent.join(clusters, "node").select("component", "node", "n", "found"))
    del sent
    remove(texts.sparkSession, [])
    sizes = saved(sets.groupBy("component").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total")))
    fits = (F.col("rows") <= REGION) & (F.col("total") <= REGION_SHINGLES)
    small = (sets.join(sizes.filter(fits).select("component"), "component")
             .select(F.col("component").alias("region"), F.lit(0).alias("block"), "node", "n", "found", F.col("node").alias("label")))
    found = joined(small, threshold, width)
    large = sizes.filter(~fits).select("component")
    with rows_per_batch(texts.sparkSession, SETS_AT_ONCE):
        if not large.isEmpty():
            cut, direct = cut_large(sets.join(large, "component"), threshold)
            found = found.unionByName(joined(cut, threshold, width)).unionByName(direct)
        return saved(found)


def joined(regions: DataFrame, threshold: Threshold, width: int) -> DataFrame:
    """Edges of the links within each region, but for those between nodes of one label; a task holds one region at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, nodes, labels = None, {}, {}
        root: dict[int, int] = {}          # what the task's regions have joined so far

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def done() -> tuple[list[int], list[int]]:
            names = sorted(nodes)
            if len(root) > SEEN:
                root.clear()
            for node, label in labels.items():
                x, y = find(node), find(label)
                root[max(x, y)] = min(x, y)
            a_side, b_side = [], []
            for i, j in join_region([nodes[x] for x in names], threshold):
                x, y = find(names[i]), find(names[j])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    a_side.append(names[i])
                    b_side.append(names[j])
            return a_side, b_side

        for b in batches:
            a_side, b_side = [], []
            for name, node, raw, label in zip(b.column("region").to_pylist(), b.column("node").to_pylist(), b.column("found"),
                                              b.column("label").to_pylist()):
                if name != region:
                    if len(nodes) > 1:
                        x, y = done()
                        a_side += x
                        b_side += y
                    region, nodes, labels = name, {}, {}
                labels[node] = label
                nodes[node] = np.frombuffer(raw.as_buffer(), np.uint64)
            # views of a batch would hold its memory
            nodes = {n: v.copy() for n, v in nodes.items()}
            if a_side:
                yield pa.RecordBatch.from_arrays([pa.array(a_side, pa.int64()), pa.array(b_side, pa.int64())], ["a", "b"])
        if len(nodes) > 1:
            x, y = done()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    keys = ["region", "block"]
    return (regions.withColumn("region", F.xxhash64(*keys)).select("region", "node", "found", "label")
            .repartition(width, "region").sortWithinPartitions("region").mapInArrow(run, "a long, b long"))


def cut_large(sets: DataFrame, threshold: Threshold) -> tuple[DataFrame, DataFrame]:
    """Regions of large clusters as (region, block, node, n, found, label), and the links found on the way.

    Nodes of one label are connected by those links (``labelled``), so only
    nodes that share a point with another label are joined.  A cluster of at
    most ``BLOCKS`` blocks is joined by pairs of blocks.  A larger one falls
    apart into its points first: the documents that agree in one projection.
    A point that is still too large is cut into Voronoi regions where that
    copies a document ``COPIES`` times at most on average, and what remains too
    large into blocks, every pair of which is a region.
    """
    different = saved(sets.dropDuplicates(["node"]).select("component", "node", "n", "found"))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [np.unique(projections(np.frombuffer(x.as_buffer(), np.uint64), threshold)) for x in b.column("found")]
            row = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            if len(row):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).astype(np.int64)), b.column("node").take(row), b.column("n").take(row)],
                    ["point", "node", "n"])

    placed = saved(different.mapInArrow(project, "point long, node long, n long"))
    placed, first_links = labelled(placed, different, threshold)
    labels = saved(placed.select("node", "label").distinct())
    members = different.select("component", "node", "n").join(labels, "node")
    per_cluster = saved(members.groupBy("component").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total"))
                        .select("component", blocks_for("rows", "total")))
    few = members.join(per_cluster.filter(F.col("blocks") <= BLOCKS), "component")
    few = in_blocks(few).select("component", "own", "other", "node")
    few = few.select(F.col("component").alias("point"), F.xxhash64(F.least("own", "other"), F.greatest("own", "other")).alias("block"), "node")
    many = members.join(per_cluster.filter(F.col("blocks") > BLOCKS), "component").select("node")
    if many.isEmpty():
        return filled(few, different, labels), first_links
    placed = saved(placed.join(many, "node"))
    sizes = saved(placed.groupBy("point").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total")).filter(F.col("rows") > 1))
    fits = (F.col("rows") <= REGION) & (F.col("total") <= REGION_SHINGLES)
    whole = (placed.join(sizes.filter(fits).select("point"), "point")
             .select("point", F.lit(0).cast("long").alias("block"), "node"))
    wide = saved(placed.join(sizes.filter(~fits), "point").select("point", "rows", "node", "n"))
    cells, direct = voronoi_cells(wide, different, threshold)
    per_cell = saved(cells.groupBy("point", "cell").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total"))
                     .select("point", "cell", blocks_for("rows", "total")))
    blocks = (in_blocks(cells.join(per_cell, ["point", "cell"]))
              .select("point", F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("block"), "node"))
    rows = few.unionByName(whole).unionByName(blocks)
    return filled(rows, different, labels), direct.unionByName(first_links)


def blocks_for(rows: str, total: str) -> Column:
    """The number of blocks for members of so many rows and shingles: pairs hold two, so these are half as large as a region."""
    parts = F.ceil(F.greatest(F.col(rows) / REGION, F.col(total) / REGION_SHINGLES)).cast("int")
    return F.when(parts > 1, 2 * parts).otherwise(1).cast("int").alias("blocks")


def in_blocks(members: DataFrame) -> DataFrame:
    """Each of ``members`` (node, blocks) once for each pair of its own block and another."""
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
    return members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))


def filled(rows: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` (point, block, node) as regions, with the nodes' sets and labels."""
    return (rows.join(sets.join(labels, "node"), "node")
            .select(F.col("point").alias("region"), "block", "node", "n", "found", "label"))


def labelled(placed: DataFrame, sets: DataFrame, threshold: Threshold) -> tuple[DataFrame, DataFrame]:
    """Rows of ``placed`` (point, node, n) in points of several labels, with the node's label, and the links behind the labels.

    In each of ``ROUNDS`` rounds a point is headed by the first node in an
    order of hashes, and a node is measured against the head of most of its
    points among those of another label; nodes connected by the links so far
    have one label.
    """
    links = None
    now = placed.withColumn("label", F.col("node"))
    for turn in range(ROUNDS):
        heads = (now.groupBy("point").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("nth"), F.col("node").alias("head"),
                                                         F.col("label").alias("head_label"))).alias("first"),
                                          F.min("label").alias("low"), F.max("label").alias("high"))
                 .filter(F.col("low") != F.col("high")).select("point", "first"))
        now = saved(now.join(heads, "point").select("point", "node", "n", "label", "first.nth", "first.head", "first.head_label"))
        chosen = (now.filter(F.col("label") != F.col("head_label")).groupBy("node", "nth", "head").agg(F.count(F.lit(1)).alias("points"))
                  .groupBy("node").agg(F.max(F.struct("points", "nth", "head")).alias("best"))
                  .select("node", F.col("best.head").alias("p_node")))
        found = chosen.join(sets.select("node", "found"), "node").join(
            sets.select(F.col("node").alias("p_node"), F.col("found").alias("p_found")), "p_node")
        new = saved(measured_pairs(found.select("node", "p_node", "found", "p_found"), "node long, p_node long")
                    .filter(F.col("both") * threshold.den >= F.col("union") * threshold.num)
                    .select(F.col("node").alias("a"), F.col("p_node").alias("b")))
        now = now.select("point", "node", "n", "label")
        if new.isEmpty():
            break
        links = new if links is None else links.unionByName(new)
        names = saved(components(links)).withColumnRenamed("component", "named")
        now = now.join(names, "node", "left").select("point", "node", "n", F.coalesce("named", "node").alias("label"))
    ends = (now.groupBy("point").agg(F.min("label").alias("low"), F.max("label").alias("high"))
            .filter(F.col("low") != F.col("high")).select("point"))
    return saved(now.join(ends, "point")), links if links is not None else new


def measured_pairs(pairs: DataFrame, keep: str) -> DataFrame:
    """The columns ``keep`` of ``pairs``, which come first, and sizes of the intersection and union of the sets found, p_found."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both, union = [], []
            for x, y in zip(b.column("found"), b.column("p_found")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                n = np.intersect1d(x, y, assume_unique=True).size
                both.append(n)
                union.append(len(x) + len(y) - n)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(both, pa.int64()), pa.array(union, pa.int64())],
                                             [*b.schema.names[:-2], "both", "union"])

    return pairs.mapInArrow(measure, f"{keep}, both long, union long")


def voronoi_cells(wide: DataFrame, sets: DataFrame, threshold: Threshold) -> tuple[DataFrame, DataFrame]:
    """(point, cell, node, n) for members of points, one cell where pivots do not tell them apart; links to pivots."""
    by_hash = Window.partitionBy("point").orderBy(F.xxhash64("node"), "node")
    pivots = saved(wide.withColumn("pivot", F.row_number().over(by_hash)).filter(F.col("pivot") <= PIVOTS)
                   .select("point", "pivot", F.col("node").alias("p_node")).join(
                       sets.select(F.col("node").alias("p_node"), F.col("found").alias("p_found")), "p_node"))

    pairs = (wide.join(sets.select("node", "found"), "node").join(pivots, "point")
             .select("point", "node", "n", "pivot", "p_node", "found", "p_found"))
    measured = saved(measured_pairs(pairs, "point long, node long, n long, pivot int, p_node long"))
    direct = (measured.filter((F.col("both") * threshold.den >= F.col("union") * threshold.num) & (F.col("node") != F.col("p_node")))
              .select(F.col("node").alias("a"), F.col("p_node").alias("b")))
    distance = measured.select("point", "node", "n", "pivot", (1 - F.col("both") / F.col("union")).alias("d"))
    near = distance.groupBy("point", "node").agg(F.min("d").alias("nearest"))
    cells = saved(distance.join(near, ["point", "node"]).filter(F.col("d") <= F.col("nearest") + 2 * threshold.eps + 1e-9)
                  .select("point", F.col("pivot").alias("cell"), "node", "n"))
    spread = saved(cells.groupBy("point").agg(F.count(F.lit(1)).alias("copies"), F.count_distinct("node").alias("rows"))
                   .filter(F.col("copies") <= COPIES * F.col("rows")).select("point"))
    apart = cells.join(spread, "point")
    alike = wide.join(spread, "point", "left_anti").select("point", F.lit(0).alias("cell"), "node", "n")
    return saved(apart.unionByName(alike)), direct


def _xxhash64(value: int) -> int:
    """Spark's xxhash64 of one long."""
    h = xxhash.xxh64_intdigest((value & (1 << 64) - 1).to_bytes(8, "little"), seed=42)
    return h - (1 << 64) if h >> 63 else h


def text_key(text: Column) -> Column:
    """A hash of a text that, with its row's id, names the row."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def one_of_each(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` less all but one of each group of linked ones: that with the smallest id.

    Rows are told apart by id and text: of two rows with one id and different
    texts each stays or goes with its own group.  Ids that are null come after
    all others, equal ids in the order of a hash of the text; of wholly
    repeated rows one stays.  Rows without words are in no group and all stay.
    """
    rows = rows_with_groups(docs, k, num, den, id_col, text_col).filter(F.col("group").isNotNull())
    name, key, nth, stays = (fresh(c, docs.columns) for c in ("row_id", "text_key", "nth", "stays"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("first")
    groups = rows.groupBy("group").agg(first, F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("group", "first")
    # only rows of groups are marked, few of the table: those that go, and those that stay once
    marks = saved(rows.join(groups, "group").groupBy(F.col("id").alias(name), F.col("text_key").alias(key))
                  .agg(F.first(F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.text_key") == F.col("text_key"))).alias(stays),
                       F.count(F.lit(1)).alias("rows")).filter(~F.col(stays) | (F.col("rows") > 1)).drop("rows"))
    named = docs.withColumns({name: docs[id_col], key: text_key(docs[text_col])})
    # a filter of bounded size lets the rows that no mark can meet, most of the table, pass without a shuffle
    word, bits = fresh("word", docs.columns), fresh("bits", docs.columns)
    place = F.pmod(F.col(key), F.lit(64 * FILTER_WORDS))
    bit, of = (place % 64).cast("int"), F.floor(place / 64).cast("int")
    words = marks.groupBy(of.alias(word)).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias(bits))
    named = named.withColumn(word, of).join(F.broadcast(words), word, "left")
    asked = F.coalesce(F.call_function("shiftright", F.col(bits), bit).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    unasked, named = named.filter(~asked), named.filter(asked)

    def met(side: DataFrame, how: str) -> DataFrame:
        return named.join(side, named[name].eqNullSafe(side[name]) & (named[key] == side[key]), how)

    once = marks.filter(stays)
    others = unasked.select(*docs.columns).unionByName(met(marks, "left_anti").select(*docs.columns))
    if once.isEmpty():
        return others
    same = Window.partitionBy(name, key).orderBy(*[F.hash(c) for c in docs.columns])
    again = met(once, "left_semi").withColumn(nth, F.row_number().over(same)).filter(F.col(nth) == 1)
    return others.unionByName(again.select(*docs.columns))
