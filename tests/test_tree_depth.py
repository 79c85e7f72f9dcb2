"""Depths by pointer doubling and by levels against a search in plain Python."""

import random

from trailfold.operators import tree

EDGE, ROOT = "experiment string, node string, child string", "experiment string, node string"


def search(edges, roots):
    children = {}
    for e, a, b in edges:
        children.setdefault((e, a), set()).add(b)
    out = {}
    for e, r in roots:
        level, depth = {r}, 1
        while level:
            for n in level:
                out[e, n] = depth
            level = {c for n in level if n is not None for c in children.get((e, n), ()) if (e, c) not in out}
            depth += 1
    return out


def found(spark, edges, roots):
    rows = tree.depths(spark.createDataFrame(sorted(set(edges)), EDGE), spark.createDataFrame(roots, ROOT)).collect()
    got = {(r["experiment"], r["node"]): r["depth"] for r in rows}
    assert len(got) == len(rows)
    return got


def test_depths_equal_a_search(spark):
    rng = random.Random(6)
    edges, roots = [], [("none", None), ("alone", "x")]
    for e in range(12):
        n = rng.randint(1, 40)
        nodes = [f"{e}.{i}" for i in range(n)]
        edges += [(str(e), nodes[rng.randrange(i)], nodes[i]) for i in range(1, n)]
        # a second tree and a cycle that the root does not reach
        edges += [(str(e), f"{e}.top", f"{e}.leaf"), (str(e), f"{e}.p", f"{e}.q"), (str(e), f"{e}.q", f"{e}.p"), (str(e), f"{e}.s", f"{e}.s")]
        if e % 3 == 0 and n > 4:
            # several parents, and a way back to the root
            edges += [(str(e), nodes[rng.randrange(n)], nodes[rng.randrange(n)]) for _ in range(4)] + [(str(e), nodes[-1], nodes[0])]
        roots.append((str(e), nodes[0]))
    assert found(spark, edges, roots) == search(edges, roots)
    assert found(spark, edges[:0] + [("other", "a", "b")], roots[:1]) == {("none", None): 1}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    jobs = []
    monkeypatch.setattr(tree, "materialize", lambda df, f=tree.materialize: (jobs.append(1), f(df))[1])
    edges = [("e", str(i), str(i + 1)) for i in range(4000)]
    got = found(spark, edges, [("e", "0")])
    assert len(got) == 4001 and got["e", "4000"] == 4001
    # one table for the experiments that are no trees, one for the edges, the rest are rounds
    assert len(jobs) - 2 <= 14
