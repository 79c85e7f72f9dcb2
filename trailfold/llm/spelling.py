"""Spelling variants of words: PartEnum signatures of letter multisets.

A word is a binary vector with one place for each (letter, how often it came
before).  Words that differ by one inserted or deleted code point differ in one
place, words that differ by one replaced code point in two or none, so near
words have a Hamming distance of at most two.  The places are dealt by letter
into ``PARTS`` parts and all choices of ``PARTS - 2`` parts are enumerated: two
vectors that differ in two places at most agree in all parts of some choice.
The hash of those parts, with the choice, is a signature; an equi-join on
signatures finds every near pair, and ``levenshtein`` verifies it.

Words of one signature are all like each other in letters only, so a signature
of more than ``CROWD`` words is joined again on the words less one code point:
near words share one, and not many words share it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailfold.llm.common import saved, text_slices

RUN = "[A-Za-zÀ-ÿ]+"
#: Every ``SLIP``-th occurrence by hash has lost a code point.
SLIP = 199
LEAST_POINTS, LEAST_COUNT, TIMES = 6, 5, 5
DISTANCE, PARTS, CROWD = 2, 6, 64
#: Distinct words that a task holds before it hands on their counts.
HELD = 200_000
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int = SLIP) -> DataFrame:
    """(word, n): runs of letters of all texts, A-Z lowered, a few by a hash of id and run without one code point.

    The hash is the crc32 of ``<id>:<run>``; where ``slip`` divides it the code
    point at its remainder by the run's length goes.  A null id is written as
    nothing, a null text has no runs, repeated rows count again.  A run that
    loses its only code point is the empty word.  Counts are added up inside
    each task before they are shuffled.
    """
    letters = re.compile(RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                             ["word", "n"])
            held.clear()
            return out

        for part in text_slices(batches, "text"):
            for key, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                if not text:
                    continue
                begin = zlib.crc32(f"{'' if key is None else key}:".encode())
                for word, n in Counter(letters.findall(text.translate(_LOWER))).items():
                    h = zlib.crc32(word.encode(), begin)
                    if h % slip == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    held[word] += n
            if len(held) > HELD:
                yield flush()
        yield flush()

    return (docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].cast("string").alias("text"))
            .mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))


def signatures(word: Column, parts: int = PARTS) -> Column:
    """The PartEnum signatures of a word's letter multiset for a Hamming distance of two: longs, one per choice."""
    # the part of a place goes by its letter: a multiset's part is the sorted letters that are dealt to it
    letters = F.array_sort(F.split(word, ""))

    def of_part(p: int) -> Callable[[Column], Column]:
        return lambda c: F.pmod(F.xxhash64(c), F.lit(parts)) == p

    dealt = [F.array_join(F.filter(letters, of_part(p)), "") for p in range(parts)]
    choices = combinations(range(parts), parts - DISTANCE)
    return F.array(*[F.xxhash64(F.lit(i), *[dealt[p] for p in choice]) for i, choice in enumerate(choices)])


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b), a < b: the distinct ``word`` s of ``words`` that differ by exactly one code point put in, out or instead.

    The signatures are equi-joined, a crowded one on the words less a code
    point as well; no pair is lost, each comes once.
    """
    signed = words.select("word", F.explode(signatures(F.col("word"))).alias("sig"))
    sizes = signed.groupBy("sig").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    signed = saved(signed.join(sizes.select("sig", (F.col("size") > crowd).alias("crowded")), "sig"))
    less = F.transform(F.sequence(F.lit(1), F.length("word")),
                       lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.length("word"))))
    few = signed.filter("not crowded").select("word", "sig", F.lit("").alias("rest"))
    many = signed.filter("crowded").select("word", "sig", F.explode(F.array_distinct(F.concat(less, F.array("word")))).alias("rest"))
    pairs = [side.select(F.col("word").alias("a"), "sig", "rest")
             .join(side.select(F.col("word").alias("b"), "sig", "rest"), ["sig", "rest"])
             .filter((F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1)
                     & (F.levenshtein("a", "b", 1) == 1)).select("a", "b")
             for side in (few, many)]
    return pairs[0].unionByName(pairs[1]).distinct()


def variants(counts: DataFrame, least_points: int = LEAST_POINTS, least_count: int = LEAST_COUNT,
             times: int = TIMES) -> DataFrame:
    """Per word (of ``least_points`` code points and ``least_count`` occurrences at least): form and root.

    ``form`` is the near word of largest n (ties: first in code-point order) if
    that is at least ``times`` the word's own, else null, ``form_n`` its n;
    ``root`` follows forms to the last; ``n_near`` counts near words.  Counts
    rise by ``times`` along forms, so a few rounds of doubling reach every
    root.  Null words go, several rows of a word are added up; no words, no
    rows.
    """
    words = saved(counts.filter(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n"))
                  .filter((F.length("word") >= least_points) & (F.col("n") >= least_count)))
    pairs = near_pairs(words.select("word"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = (both.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b").groupBy("a")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("least"), "b")).alias("best"))
            .select(F.col("a").alias("word"), "n_near", F.col("best.b").alias("b"), (-F.col("best.least")).alias("m")))
    good = F.col("m") >= times * F.col("n")
    known = saved(words.join(near, "word", "left")
                  .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                          F.when(good, F.col("b")).alias("form"), F.when(good, F.col("m")).alias("form_n")))
    hops = known.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        hops = saved(hops.join(on, "root", "left")
                     .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if hops.filter("moved").isEmpty():
            break
        hops = hops.select("word", "root")
    return (known.join(hops.select("word", "root"), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
