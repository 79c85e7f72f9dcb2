"""Best-fit packing of tokenised documents by bin completion.

Documents are encoded where they lie (map-only) and cut into pieces.  How to
pack depends on the pieces' lengths alone, so the driver sees one count per
length — at most ``capacity`` rows, whatever the corpus — and works on whole
patterns: a bin around the largest length that is left, completed by the
undominated fillings of the rest of the room, repeated as often as the counts
allow.  Best-fit solutions are the incumbents; branches whose waste already
rules out a better solution are pruned.  Pieces then find their place by their
rank among those of equal length, which is numbered in hash buckets, so a
length that a third of all pieces share is no single task.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trailfold.llm import words as W
from trailfold.llm.common import saved, shuffle_width, text_bytes, text_slices

CAPACITY = 2048
#: Entries of a task's memo of words; a full memo starts anew.
MEMO = 1_000_000
#: Steps of the search beyond the best-fit incumbents.
NODES = 3_000
#: Fillings tried per step, and the steps looked at to find them.
WIDTH, LOOKS = 4, 300


class WordEncoder:
    """Token ids of many texts at once, word by word.

    The tokenizer drops white space and never joins over it, so each word
    between ASCII white space is encoded by itself, and so is a full stop or
    comma after a word that ends in a letter.  Words are told apart by 64-bit
    hashes, A-Z taken as a-z as the tokenizer does; only where a word holds a
    bar (of a special token) or characters beyond U+02FF (marks that may join a
    letter before its case changes) is it taken as it stands.  Each word is
    encoded once, up to ``MEMO`` words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.slot: dict[int, int] = {}
        self.size, self.at = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.used = np.zeros(1 << 18, "<u4"), 0

    def learn(self, names: list[int], words: list[str]) -> None:
        """Encode new words; those of plain letters end with one token that marks an end, so many go at once."""
        plain = [i for i, w in enumerate(words) if w.isascii() and w.isalpha()]
        other = [i for i, w in enumerate(words) if not (w.isascii() and w.isalpha())]
        groups = [plain[i:i + 50] for i in range(0, len(plain), 50)]
        joined = [" ".join([words[i] for i in g]) for g in groups]
        found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        sizes = [np.diff(np.flatnonzero(self.ends[f]) + 1, prepend=0) for f in found]
        found += [np.array(e.ids, "<u4") for e in
                  self.tokenizer.encode_batch_fast([words[i] for i in other], add_special_tokens=False)]
        sizes += [np.array([len(f)]) for f in found[len(groups):]]
        flat, size = np.concatenate(found), np.concatenate(sizes)
        first = len(self.slot)
        while first + len(size) > len(self.size):
            self.size, self.at = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.at))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used:self.used + len(flat)] = flat
        self.size[first:first + len(size)] = size
        self.at[first:first + len(size)] = self.used + np.cumsum(size) - size
        self.used += len(flat)
        self.slot.update(zip([names[i] for i in [*plain, *other]], range(first, first + len(size)), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after the other, and the number of each text's."""
        if len(self.slot) > MEMO:
            self.forget()
        starts, ends, text = W.spans(data, offsets)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(offsets) - 1, np.int64)
        lower = W.LOWER[data]
        stop = (ends - starts > 1) & ((data[ends - 1] == 44) | (data[ends - 1] == 46))
        before = lower[np.maximum(ends - 2, 0)]
        stop &= (before >= 97) & (before <= 122)
        order = np.argsort(np.concatenate([starts, ends[stop] - 1]), kind="stable")
        starts, ends, text = (np.concatenate(x)[order] for x in (
            (starts, ends[stop] - 1), (ends - stop, ends[stop]), (text, text[stop])))
        odd = np.concatenate([[0], np.cumsum((data >= 0xCC) | (data == 124))])
        odd = odd[ends] > odd[starts]
        names = W.hashes(data, starts, ends)
        if odd.any():
            names[odd] = ~W.hashes(data, starts, ends, lower=False)[odd]
        names, first, which = np.unique(names, return_index=True, return_inverse=True)
        known = [self.slot.get(x, -1) for x in names.tolist()]
        new = [i for i, x in enumerate(known) if x < 0]
        if new:
            at = first[new]
            raw, small = data.tobytes(), lower.tobytes()
            self.learn(names[new].tolist(), [(raw if o else small)[a:b].decode() for o, a, b in zip(
                odd[at].tolist(), starts[at].tolist(), ends[at].tolist())])
            known = [self.slot[x] for x in names.tolist()]
        slots = np.array(known)[which]
        size = self.size[slots]
        ends_at = np.cumsum(size)
        ids = self.ids[np.arange(ends_at[-1]) + np.repeat(self.at[slots] - ends_at + size, size)]
        return ids, np.bincount(text, size, len(offsets) - 1).astype(np.int64)


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Each text's ids and a final id 0, cut into pieces of ``capacity``: id, piece, start, length, ids_crc32."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for part in text_slices(batches, "text"):
            ids, sizes = encoder.encode(*text_bytes(part.column("text")))
            raw, ends = ids.tobytes(), np.cumsum(sizes)
            first = ends - sizes
            sizes = sizes + 1
            per = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), per)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            crc = []
            for a, n, last in zip((first[row] + start).tolist(), length.tolist(), (start + length == sizes[row]).tolist()):
                # a text's last id is the 0 that follows it
                crc.append(zlib.crc32(b"\0\0\0\0", zlib.crc32(raw[4 * a:4 * (a + n - 1)])) if last
                           else zlib.crc32(raw[4 * a:4 * (a + n)]))
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["id", "piece", "start", "length", "ids_crc32"])

    return (docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
            .mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long"))


# ------------------------------------------------------------------ the plan

def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: by volume, and by pieces too large to stand together."""
    sizes = np.array(sorted(counts), np.int64)
    number = np.array([counts[s] for s in sizes], np.int64)
    best = -(-int((sizes * number).sum()) // capacity)
    for small in range(1, capacity // 2 + 1):
        large = int(number[sizes > capacity - small].sum())
        half = (sizes > capacity // 2) & (sizes <= capacity - small)
        rest = (sizes >= small) & (sizes <= capacity // 2)
        over = int((sizes * number)[rest].sum()) - (int(number[half].sum()) * capacity - int((sizes * number)[half].sum()))
        best = max(best, large + int(number[half].sum()) + max(0, -(-over // capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Patterns (copies, lengths): the largest piece left, then again and again the largest that fits."""
    left = counts.copy()
    out = []
    while left.any():
        lengths: list[int] = []
        room = capacity
        used: dict[int, int] = {}
        while room and (fit := _largest(left, used, room)):
            lengths.append(fit)
            used[fit] = used.get(fit, 0) + 1
            room -= fit
        out.append((_take(left, lengths), lengths))
    return out


def _largest(left: np.ndarray, used: dict[int, int], room: int) -> int:
    for size in np.flatnonzero(left[1:room + 1])[::-1] + 1:
        if left[size] > used.get(int(size), 0):
            return int(size)
    return 0


def _take(left: np.ndarray, lengths: list[int]) -> int:
    sizes, times = np.unique(np.array(lengths), return_counts=True)
    copies = int((left[sizes] // times).min())
    left[sizes] -= copies * times
    return copies


def fillings(left: np.ndarray, room: int, most: int, width: int = WIDTH) -> list[list[int]]:
    """Undominated fillings of ``room``, least waste first, at most ``width``.

    Larger pieces are tried first, so of equal waste those with few large
    pieces come first.  A filling is dominated by one whose single pieces can
    take the place of groups of its own.
    """
    found: list[tuple[int, list[int]]] = []
    looks = 0

    def walk(room: int, most: int, chosen: list[int]) -> bool:
        nonlocal looks
        looks += 1
        limit = min(room, most)
        if limit and room <= most and left[room] > chosen.count(room):
            found.append((0, chosen + [room]))
            return len([1 for waste, _ in found if not waste]) >= width or looks > LOOKS
        sizes = (np.flatnonzero(left[1:limit + 1])[::-1] + 1)[:6].tolist() if limit else []
        sizes = [s for s in sizes if left[s] > chosen.count(s)]
        if not sizes:
            found.append((room, chosen))
        for s in sizes:
            if walk(room - s, s, chosen + [s]) or looks > LOOKS:
                return True
        return False

    walk(room, most, [])
    found.sort(key=lambda f: (f[0], len(f[1]), [-s for s in f[1]]))
    kept: list[list[int]] = []
    for _, lengths in found:
        if len(kept) < width and lengths not in kept and not any(_dominates(k, lengths) for k in kept):
            kept.append(lengths)
    return kept


def _dominates(one: list[int], other: list[int]) -> bool:
    """Whether the pieces of ``other`` fit into the pieces of ``one`` as into bins, largest first."""
    rooms = sorted(one)
    for size in sorted(other, reverse=True):
        fit = next((i for i, r in enumerate(rooms) if r >= size), None)
        if fit is None:
            return False
        rooms[fit] -= size
        rooms.sort()
    return len(one) < len(other) or sum(one) > sum(other)


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[int, list[int]]]:
    """Patterns (copies, lengths) that pack all pieces into as few bins as found."""
    total = sum(s * n for s, n in counts.items())
    bound = lower_bound(counts, capacity) if counts else 0
    start = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        start[s] = n
    best = best_fit(start, capacity)
    bins = sum(n for n, _ in best)
    spent = 0
    # depth first: (what is left, patterns so far, waste so far)
    stack: list[tuple[np.ndarray, list, int, int]] = [(start, [], 0, 0)]
    while stack and bins > bound and spent < nodes:
        left, done, used, waste = stack.pop()
        while spent < nodes:
            # a solution with one bin less than the incumbent may waste this much at most
            if waste > (bins - 1) * capacity - total:
                break
            sizes = np.flatnonzero(left)
            if not len(sizes):
                best, bins = done, used
                break
            spent += 1
            largest = int(sizes[-1])
            rest = left.copy()
            rest[largest] -= 1
            options = fillings(rest, capacity - largest, capacity - largest)
            for other in options[:0:-1]:
                after = left.copy()
                copies = _take(after, [largest, *other])
                lost = copies * (capacity - largest - sum(other))
                stack.append((after, done + [(copies, [largest, *other])], used + copies, waste + lost))
            del stack[:-64]
            left = left.copy()
            copies = _take(left, [largest, *options[0]])
            done = done + [(copies, [largest, *options[0]])]
            used, waste = used + copies, waste + copies * (capacity - largest - sum(options[0]))
            if not left.any():
                if used < bins:
                    best, bins = done, used
                break
            # whatever is left, best fit may finish it
            if spent % 64 == 0 and (tail := best_fit(left, capacity)) and used + sum(n for n, _ in tail) < bins:
                best, bins = done + tail, used + sum(n for n, _ in tail)
                if bins == bound:
                    break
    return best


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of ``docs`` is packed, repeated rows once each; a null or empty
    text is the piece of the single id 0; a null id stays null; other columns
    are not read; an empty table gives no rows.  Within a sequence the offsets
    run from 0 without gaps.
    """
    spark = docs.sparkSession
    cut = saved(pieces(docs, path, capacity, id_col, text_col))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    patterns = plan(counts, capacity)
    # places of each length, in the order of ranks: first rank, first sequence, offset
    places: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for copies, lengths in patterns:
        at = 0
        for size in lengths:
            rank = taken.get(size, 0)
            places.setdefault(size, []).append((rank, sequence, at))
            taken[size] = rank + copies
            at += size
        sequence += copies
    span = max(counts.values(), default=0) + 1
    flat = [(size * span + rank, seq, at) for size in sorted(places) for rank, seq, at in places[size]]
    key, seqs, offsets = (np.array(c, np.int64) for c in (zip(*flat) if flat else ((), (), ())))

    # ranks within a length: numbered in hash buckets, buckets one after the other
    order = ["id", "piece", "start", "ids_crc32"]
    width = shuffle_width(spark)
    spread = cut.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(width)).cast("int"))
    before = (spread.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n"))
              .drop("n"))
    local = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order))
    ranked = (spread.withColumn("local", local).join(before, ["length", "bucket"])
              .withColumn("rank", (F.col("local") + F.col("before") - 1).cast("long"))
              .select("id", "piece", "start", "length", "ids_crc32", "rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column("rank").to_numpy()
            wanted = b.column("length").to_numpy() * span + rank
            slot = np.searchsorted(key, wanted, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(seqs[slot] + wanted - key[slot]), pa.array(offsets[slot])],
                ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, "
                                    "sequence_id long, offset long").withColumnRenamed("id", id_col)


def sequences_needed(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """Sequences that the lengths need by volume alone."""
    return math.ceil(sum(s * n for s, n in counts.items()) / capacity)
