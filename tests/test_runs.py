"""Runs and their n-grams, in blocks, against plain Python."""

import itertools
import random
from collections import Counter

from helpers import trace
from trailfold.operators import sequence


def runs_of(rules):
    return [(rule, len(list(g))) for rule, g in itertools.groupby(rules)]


def test_blocks_give_all_runs_and_grams(spark, monkeypatch):
    rng = random.Random(2)
    events = {f"e{n}": [rng.choice("abc") if rng.random() < 0.6 else "a" for _ in range(n)] for n in (1, 2, 3, 4, 5, 9, 60)}
    t = None
    for name, rules in events.items():
        one = trace(spark, [(float(i), r, None, None, None) for i, r in enumerate(rules)], name)
        t = one if t is None else t.unionByName(one)
    for size in (4, 4096):
        monkeypatch.setattr(sequence, "BLOCK", size)
        got = {(r.experiment, r.run_no): (r.rule, r.run_len) for r in sequence.rle_runs(t).collect()}
        assert got == {(e, i): run for e, rules in events.items() for i, run in enumerate(runs_of(rules), 1)}
        grams = {(r.experiment, r.n, r.gram): r.cnt for r in sequence.rle_ngrams(t).collect()}
        want = Counter()
        for e, rules in events.items():
            seq = [r for r, _ in runs_of(rules)]
            want.update((e, n, " ".join(seq[i:i + n])) for n in (2, 3, 4) for i in range(len(seq) - n + 1))
        assert grams == dict(want)


def test_grams_need_no_join_each(spark):
    t = trace(spark, [(float(i), "ab"[i % 2], None, None, None) for i in range(9)])
    plan = sequence.rle_ngrams(t)._jdf.queryExecution().optimizedPlan().toString()
    # blocks with the experiment's end, runs with their block, and one of the landing on either side
    assert sequence.rle_ngrams(t).count() == 6 and plan.count("Join") <= 4
