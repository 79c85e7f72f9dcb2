"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of byte counts: contexts of up to ``order``
bytes within a word and the space before it.  A byte is coded in the longest
context that the tree has; a byte not seen there costs the escape (as many
shares as there are different bytes in the context) and is coded in the next
shorter one, without those already excluded, at last uniformly.  With frozen
statistics the code length of a byte depends on its context alone, so the tree
is compiled into an automaton: per state and byte the exact code length in bits
and the next state.  A text's code length is the sum over its words; the
language with the shortest code is predicted.

The trees are fitted on a bounded sample (``per_language`` labelled texts of at
most ``longest`` characters for each language, those with the smallest hash of
their id), gathered on the driver; scoring reads every text whole, map-only.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailfold.llm import words as W
from trailfold.llm.common import text_bytes, text_slices

ORDER, PER_LANGUAGE, LONGEST = 4, 1200, 20_000
#: A word's context starts anew after so many bytes.
SPAN = 64
SPACE = 32
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: Texts predicted with less are rejected where only clear ones are kept.
CLEAR = 0.5
HASHES = 1 << 30


@dataclass
class Automaton:
    """All languages' automata in one table: code lengths and next states by state and symbol."""
    languages: list[str]
    symbol: np.ndarray
    bits: np.ndarray
    following: np.ndarray
    start: np.ndarray


def _counts(word_counts: Counter[bytes], order: int) -> dict[bytes, Counter[int]]:
    tree: dict[bytes, Counter[int]] = defaultdict(Counter)
    for word, n in word_counts.items():
        coded = b" " + word + b" "
        for i in range(1, len(coded)):
            for k in range(min(order, i) + 1):
                tree[coded[i - k:i]][coded[i]] += n
    # a context seen once predicts nothing that its suffix doesn't
    return {c: t for c, t in tree.items() if len(c) < 2 or t.total() > 1}


def compile_trees(by_language: dict[str, Counter[bytes]], order: int = ORDER) -> Automaton:
    """The automaton for word counts by language (words lower-cased in A-Z)."""
    used = sorted({b for counts in by_language.values() for w in counts for b in w} | {SPACE})
    symbol = np.full(256, len(used), np.int64)
    symbol[used] = np.arange(len(used))
    width = len(used) + 1
    shares = np.ones(width)
    shares[-1] = max(1, 256 - len(used))
    languages, bits, following, start = sorted(by_language), [], [], []
    base = 0
    for language in languages:
        tree = _counts(by_language[language], order)
        contexts = sorted(tree, key=lambda c: (len(c), c))
        if b"" not in tree or b" " not in tree:
            contexts = sorted({b"", b" ", *contexts}, key=lambda c: (len(c), c))
        state = {c: i for i, c in enumerate(contexts)}
        table = np.zeros((len(contexts), width))
        for c, t in tree.items():
            table[state[c], symbol[list(t)]] = list(t.values())
        cost = np.zeros((len(contexts), width))
        step = np.zeros((len(contexts), width), np.int32)
        for c, i in state.items():
            chance, escape, left = np.zeros(width), 1.0, np.ones(width, bool)
            suffix = c
            while True:
                if suffix in state:
                    seen = table[state[suffix]] * left
                    total, kinds = seen.sum(), np.count_nonzero(seen)
                    if total:
                        chance += escape * seen / (total + kinds)
                        escape *= kinds / (total + kinds)
                        left &= seen == 0
                if not suffix:
                    break
                suffix = suffix[1:]
            rest = shares * left
            chance += escape * rest / max(rest.sum(), 1)
            cost[i] = -np.log2(np.maximum(chance / shares, 1e-30))
            for j, b in enumerate([*used, -1]):
                after = (c + bytes([b]))[-order:] if b >= 0 else b""
                while after not in state:
                    after = after[1:]
                step[i, j] = state[after]
        bits.append(cost.astype(np.float32))
        following.append(step + base)
        start.append(state[b" "] + base)
        base += len(contexts)
    if not languages:
        return Automaton([], symbol, np.zeros((0, width), np.float32), np.zeros((0, width), np.int32), np.zeros(0, int))
    return Automaton(languages, symbol, np.concatenate(bits), np.concatenate(following), np.array(start))


def code_lengths(model: Automaton, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of every text in every language (languages x texts)."""
    texts = len(offsets) - 1
    out = np.zeros((len(model.languages), texts))
    starts, ends, text = W.spans(data, offsets)
    if not len(starts) or not texts:
        return out
    if (ends - starts).max() > SPAN:
        parts = -(-(ends - starts) // SPAN)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, last, text = np.repeat(starts, parts) + nth * SPAN, np.repeat(ends, parts), np.repeat(text, parts)
        ends = np.minimum(starts + SPAN, last)
    # equal words have equal code lengths: each is coded once per slice
    _, first, which = np.unique(W.hashes(data, starts, ends), return_index=True, return_inverse=True)
    size = (ends - starts)[first]
    order = np.argsort(-size, kind="stable")
    at, size = starts[first][order], size[order]
    symbols = model.symbol[W.LOWER[data]]
    state = np.repeat(model.start[:, None], len(at), axis=1)
    bits = np.zeros(state.shape)
    for i in range(int(size[0]) + 1 if len(size) else 0):
        n = int(np.searchsorted(-size, -i, side="right"))
        # n words have i bytes or more; those with exactly i end here, with a space
        coded = np.full(n, model.symbol[SPACE])
        inner = size[:n] > i
        coded[inner] = symbols[at[:n][inner] + i]
        bits[:, :n] += model.bits[state[:, :n], coded]
        state[:, :n] = model.following[state[:, :n], coded]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    place = place[which]
    for j in range(len(model.languages)):
        out[j] = np.bincount(text, bits[j][place], texts)
    return out


def fit(docs: DataFrame, train: Column, order: int = ORDER, per_language: int = PER_LANGUAGE,
        longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Automaton:
    """Context trees from a bounded sample of the rows where ``train`` holds and language and text are not null."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"),
                       train.alias("train"))
    rows = rows.filter(F.col("train") & F.col("lang").isNotNull() & F.col("text").isNotNull()
                       & F.col("id").isNotNull() & (F.length("text") <= longest))
    named = rows.select("id", "lang", F.pmod(F.xxhash64("id"), F.lit(HASHES)).alias("hash"))
    # twice the share of hashes that a language needs on average, then the smallest ones exactly
    sizes = {r["lang"]: r["count"] for r in named.groupBy("lang").count().collect()}
    enough = F.lit(False)
    for lang, n in sizes.items():
        enough = enough | (F.col("lang").eqNullSafe(F.lit(lang)) & (F.col("hash") <= int(HASHES * min(1.0, (2 * per_language + 100) / n))))
    by_hash = Window.partitionBy("lang").orderBy("hash", "id")
    chosen = (named.filter(enough).withColumn("nth", F.row_number().over(by_hash))
              .filter(F.col("nth") <= per_language).select("id", "lang").distinct())
    # at most per_language rows for each language: a bounded side
    sample = rows.select("id", "lang", "text").join(F.broadcast(chosen), ["id", "lang"], "left_semi")
    counts: dict[str, Counter[bytes]] = defaultdict(Counter)
    lower = bytes(W.LOWER)
    taken: Counter[str] = Counter()
    for r in sample.toLocalIterator():
        taken[r["lang"]] += 1
        if taken[r["lang"]] <= per_language:
            counts[r["lang"]].update(w[i:i + SPAN] for w in r["text"].encode().translate(lower).split()
                                     for i in range(0, len(w), SPAN))
    return compile_trees({k: c for k, c in counts.items() if c}, order)


def identify(docs: DataFrame, model: Automaton, id_col: str = "doc_id", text_col: str = "text",
             keep: tuple[str, ...] = (), pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Per row: the id, the ``keep`` columns, the prediction and its posterior, named ``pred`` and ``score``.

    Every row gives one, repeated rows too.  A null text, one without a
    letter, and any text where no language was learned get ``und`` and score
    0.  Of languages with equal code lengths the first by name is taken.
    """
    kept = [id_col, *[c for c in keep if c not in (id_col, text_col)]]
    kinds = [docs.schema[c].dataType for c in kept]
    names = [f"k{i}" for i in range(len(kept))]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    with_text = text_col in keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in text_slices(batches, "text"):
            texts = part.column("text")
            lettered = np.array([bool(t and LETTER.search(t)) for t in texts.to_pylist()])
            if m.languages:
                bits = code_lengths(m, *text_bytes(texts))
                best = bits.argmin(axis=0)
                chance = 1 / np.exp2(np.maximum(bits.min(axis=0) - bits, -1000)).sum(axis=0)
                found = [m.languages[i] if ok else UNKNOWN for i, ok in zip(best, lettered)]
                chance = np.where(lettered, chance, 0.0)
            else:
                found, chance = [UNKNOWN] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(n) for n in names], *([texts] if with_text else []),
                 pa.array(found, pa.string()), pa.array(chance, pa.float64())],
                [*names, *(["text"] if with_text else []), "lang_pred", "score"])

    schema = ", ".join([*[f"{n} {k.simpleString()}" for n, k in zip(names, kinds)],
                        *(["text string"] if with_text else []), "lang_pred string", "score double"])
    out = docs.select(*[docs[c].alias(n) for c, n in zip(kept, names)], docs[text_col].alias("text")).mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, names)],
                      *([F.col("text").alias(text_col)] if with_text else []), F.col("lang_pred").alias(pred),
                      F.col("score").alias(score))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the fold that is never learned from: crc32 of the id as text divides by ``folds``; false for no id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))
