"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import llm_cases as cases
import pytest

from trailfold.llm import queries, spelling as S


def brute_counts(rows):
    out = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 199 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            out[word] += 1
    return out


def near(a, b):
    """Exactly one code point put in, out or instead."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts):
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    hoods = {}
    for w in words:
        for v in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            hoods.setdefault(v, []).append(w)
    found = {w: set() for w in words}
    for hood in hoods.values():
        for a in hood:
            found[a] |= {b for b in hood if near(a, b)}
    form = {}
    for w, ns in found.items():
        best = min(ns, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(found[w]), None if form[w] is None else words[form[w]])
    return out


def as_rows(df):
    out = {}
    for r in df.collect():
        assert r["word"] not in out
        out[r["word"]] = (r["form"], r["root"], r["n"], r["n_near"], r["form_n"])
    return out


@pytest.mark.parametrize("held", [200_000, 3])
def test_counts_equal_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(S, "HELD", held)
    rng = random.Random(4)
    words = ["Étude", "naïve", "letter", "x", "ÀÉ", "STRASSE", "Straße", "a×b÷c", "ŒUVRE", "日本word"]
    rows = [(i if i % 7 else None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) if i % 11 else None) for i in range(300)]
    got = {r["word"]: r["n"] for r in S.word_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == dict(brute_counts(rows))


@pytest.mark.parametrize("crowd", [64, 2])
def test_variants_equal_brute_force(spark, crowd, monkeypatch):
    rng = random.Random(9)
    counts = Counter()
    for _ in range(120):
        word = "".join(rng.choice("abcdé") for _ in range(rng.randint(5, 12)))
        n = rng.choice([5, 30, 200, 2000, 60_000])
        counts[word] += n
        for _ in range(rng.randint(0, 8)):
            i = rng.randrange(len(word))
            word = rng.choice([word[:i] + word[i + 1:], word[:i] + rng.choice("abz") + word[i:], word[:i] + rng.choice("abz") + word[i + 1:]])
            n = max(3, n // rng.choice([1, 5, 6, 20]))
            counts[word] += n
    df = spark.createDataFrame(list(counts.items()) + [(None, 9)], "word string, n long")
    monkeypatch.setattr(S, "near_pairs", lambda w, f=S.near_pairs: f(w, crowd))
    got = as_rows(S.variants(df))
    want = brute(counts)
    assert got == want
    assert any(v[1] not in (k, v[0]) for k, v in want.items())


def test_awkward_spelling(spark):
    docs = cases.awkward(spark)
    got = {r["word"]: r["n"] for r in S.word_counts(docs).collect()}
    assert got == dict(brute_counts((r["doc_id"], r["text"]) for r in docs.collect()))
    assert S.variants(S.word_counts(cases.empty(spark))).count() == 0
    assert S.variants(S.word_counts(docs.limit(2))).count() == 0


@pytest.mark.skipif(not cases.HAVE_SF, reason="driver test data not present")
def test_query_equals_brute_force_on_real_texts(spark):
    got = as_rows(queries.op12_spelling_variants(spark, cases.SF))
    want = brute(brute_counts((r["doc_id"], r["text"]) for r in cases.texts(spark).collect()))
    assert got == want and any(v[0] for v in want.values())
