"""Longest simple paths against a search in plain Python, and graphs that no list of paths could hold."""

import random

from trailfold.operators import longest_path, tree

EDGE, ROOT = "experiment string, node string, child string", "experiment string, node string"


def search(edges, roots):
    children = {}
    for e, a, b in set(edges):
        children.setdefault((e, a), []).append(b)

    def longest(e, node, passed):
        return 1 + max((longest(e, c, passed | {c}) for c in children.get((e, node), ()) if c not in passed), default=0)

    return {e: longest(e, r, {r}) if r is not None else 1 for e, r in roots}


def found(spark, edges, roots):
    edges, roots = spark.createDataFrame(sorted(set(edges)), EDGE), spark.createDataFrame(roots, ROOT)
    rows = longest_path.longest_paths(edges, roots, tree._depths_by_level(edges, roots)).collect()
    got = {r["experiment"]: r["d"] for r in rows}
    assert len(got) == len(rows)
    return got


def test_random_graphs_equal_a_search(spark):
    rng = random.Random(11)
    edges, roots = [], [("none", None), ("alone", "x")]
    for e in range(40):
        n, more = rng.randint(1, 9), rng.choice((1.0, 1.5, 2.2))
        edges += [(str(e), f"v{rng.randrange(n)}", f"v{rng.randrange(n)}") for _ in range(int(n * more))]
        roots.append((str(e), "v0"))
    # two cycles, one way between them by a node of no cycle, loops, and a cycle that the root does not reach
    edges += [("two", a, b) for a, b in ["ab", "bc", "ca", "cm", "mx", "xy", "yx", "yz", "zz", "pq", "qp", "pa"]]
    roots.append(("two", "a"))
    want = search(edges, roots)
    assert want["two"] == 7 and found(spark, edges, roots) == want


def test_components_equal_mutual_reach(spark):
    rng = random.Random(5)
    edges = {(str(e), f"{rng.randrange(12):02d}", f"{rng.randrange(12):02d}") for e in range(8) for _ in range(16)}
    edges = {x for x in edges if x[1] != x[2]}
    reach = {}
    for e, a, b in edges:
        reach.setdefault((e, a), set()).add(b)
    grown = True
    while grown:
        grown = False
        for (e, a), seen in reach.items():
            more = set().union(*(reach.get((e, b), set()) for b in seen)) - seen
            grown |= bool(more)
            seen |= more
    want = {(e, a): frozenset(b for b in seen if a in reach.get((e, b), ())) for (e, a), seen in reach.items() if a in seen}
    groups = {}
    for r in longest_path.components(spark.createDataFrame(sorted(edges), EDGE)).collect():
        groups.setdefault((r["experiment"], r["comp"]), set()).add(r["node"])
    got = {(e, n): frozenset(g) for (e, _), g in groups.items() for n in g if len(g) > 1}
    assert got == want


def test_a_ladder_of_two_to_the_forty_paths(spark):
    rungs = [(f"a{i}", f"m{i}.{j}", f"a{i + 1}") for i in range(8) for j in range(32)]
    edges = [("e", a, m) for a, m, _ in rungs] + [("e", m, b) for _, m, b in rungs]
    assert found(spark, edges, [("e", "a0")]) == {"e": 17}


def test_an_equal_set_of_nodes_is_passed_once(spark):
    # all ways between ten nodes: 986,410 simple paths, but 2,305 sets of nodes with an end
    nodes = [f"n{i}" for i in range(10)]
    edges = spark.createDataFrame([("e", a, b) for a in nodes for b in nodes if a != b], EDGE)
    roots = spark.createDataFrame([("e", "n0")], ROOT)
    spans = longest_path._spans(edges, roots).collect()
    assert {r["node"]: r["length"] for r in spans} == {n: 10 if n != "n0" else 1 for n in nodes}


def test_states_of_small_components_are_no_rows(spark, monkeypatch):
    rows = []
    monkeypatch.setattr(longest_path, "materialize", lambda df, f=longest_path.materialize: (out := f(df), rows.append(out.count()))[0])
    nodes = [f"n{i}" for i in range(10)]
    assert found(spark, [("e", a, b) for a in nodes for b in nodes if a != b], [("e", "n0")]) == {"e": 10}
    assert max(rows) <= 90


def test_components_beyond_the_bound_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(longest_path, "SMALL", 3)
    rng = random.Random(3)
    edges = [(str(e), f"v{rng.randrange(7)}", f"v{rng.randrange(7)}") for e in range(12) for _ in range(14)]
    roots = [(str(e), "v0") for e in range(12)]
    assert found(spark, edges, roots) == search(edges, roots)
