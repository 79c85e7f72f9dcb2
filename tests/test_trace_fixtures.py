"""Micro-fixtures for the per-experiment fold (process tree, entities, rates, runs, top processes)."""

from helpers import det, one, pc, trace

from trailfold.operators import entities, processes, rates, sequence, summary, tree


def _tree(spark, rows):
    t = trace(spark, rows)
    return one(tree.process_tree(t)), one(tree.tree_depth_dfs(t))


def test_chain_of_four(spark):
    pt, dfs = _tree(spark, [det(), pc("root", "a"), pc("a", "b"), pc("b", "c")])
    assert (pt.max_tree_depth, pt.max_branching_factor, pt.total_processes) == (4, 1, 4)
    assert dfs.max_tree_depth == 4


def test_star_of_five(spark):
    pt, _ = _tree(spark, [det()] + [pc("root", x) for x in "abcd"])
    assert (pt.max_tree_depth, pt.max_branching_factor, pt.root_spawned_children) == (2, 4, 4)


def test_dag_shortest_vs_longest(spark):
    pt, dfs = _tree(spark, [det(), pc("root", "a"), pc("root", "b"), pc("a", "b"), pc("b", "c")])
    assert pt.max_tree_depth == 3      # BFS hop count + 1
    assert dfs.max_tree_depth == 4     # longest simple path (variant B)


def test_cycle_terminates(spark):
    pt, dfs = _tree(spark, [det(), pc("root", "a"), pc("a", "b"), pc("b", "a")])
    assert pt.max_tree_depth == 3
    assert dfs.max_tree_depth == 3


def test_duplicate_edge(spark):
    pt, _ = _tree(spark, [det(), pc("root", "a"), pc("root", "a")])
    assert (pt.max_branching_factor, pt.total_processes, pt.root_spawned_children) == (2, 2, 2)


def test_root_last_detonation_and_fallback(spark):
    t = trace(spark, [det(0, "x"), det(1, "y"), pc("y", "z", 2)])
    assert one(tree.root_process(t)).root_guid == "y"
    t = trace(spark, [(0.0, "file_create", "p0", None, "f"), pc("p0", "p1", 1)])
    assert one(tree.root_process(t)).root_guid == "p0"


def test_null_names_count_once(spark):
    t = trace(spark, [det(), (1, "file_create", "root", None, None), (2, "file_create", "root", None, None),
                      (3, "file_create", "root", None, "f1")])
    assert one(entities.entity_counts(t)).unique_files_created == 2


def test_tied_timestamps_keep_file_order(spark):
    t = trace(spark, [det(), (1, "file_create", "root", None, "a"), (1, "reg_write", "root", None, "k"),
                      (1, "file_create", "root", None, "b")])
    assert one(sequence.rle_text(t)).flow == "detonation -> file_create -> reg_write -> file_create"


def test_single_event_and_same_instant(spark):
    r = one(rates.trace_rates(trace(spark, [det()])))
    assert (r.total_events, r.duration_seconds, r.avg_events_per_sec, r.peak_events_per_sec) == (1, 0.0, 1.0, 1)
    r = one(rates.trace_rates(trace(spark, [det(), (0.0, "file_create", "root", None, "a"),
                                            (0.0, "file_create", "root", None, "b")])))
    assert (r.avg_events_per_sec, r.peak_events_per_sec) == (3.0, 3)


def test_rate_rounding_half_even(spark):
    r = one(rates.trace_rates(trace(spark, [det(0.0), (16.0, "file_create", "root", None, "a")])))
    assert r.avg_events_per_sec == 0.12


def test_tumbling_and_sliding_peaks(spark):
    t = trace(spark, [det(0.0), (0.9, "file_create", "root", None, "a"), (1.1, "file_create", "root", None, "b"),
                      (1.2, "file_create", "root", None, "c")])
    assert one(rates.trace_rates(t)).peak_events_per_sec == 2
    assert one(rates.sliding_peak(t)).peak_sliding == 3


def _alternating(n_runs):
    rows = [det()]
    for i in range(1, n_runs):
        rows.append((float(i), "file_create" if i % 2 else "reg_write", "root", None, f"x{i}"))
    return rows


def test_run_display_limit(spark):
    d = one(sequence.rle_display(trace(spark, _alternating(41))))
    assert d.n_runs == 41 and len(d.runs) == 41 and d.runs[-1] == "... [1 further event runs omitted]"
    d = one(sequence.rle_display(trace(spark, _alternating(45))))
    assert d.runs[-1] == "... [5 further event runs omitted]" and len(d.runs) == 41
    d = one(sequence.rle_display(trace(spark, _alternating(40))))
    assert len(d.runs) == 40 and not d.runs[-1].startswith("...")


def test_run_lengths(spark):
    t = trace(spark, [det(), (1, "file_create", "root", None, "a"), (2, "file_create", "root", None, "b"),
                      (3, "reg_write", "root", None, "k")])
    assert one(sequence.rle_text(t)).flow == "detonation -> file_create x2 -> reg_write"
    runs = sorted(sequence.rle_runs(t).collect(), key=lambda r: r.run_no)
    assert [r.run_len for r in runs] == [1, 2, 1] and sum(r.run_len for r in runs) == 4


def test_top_five_ties_first_seen_and_root_tag(spark):
    rows = [det(0, "p1")]
    t = 1.0
    for p, n in (("p1", 5), ("p2", 4), ("p3", 3), ("p4", 2), ("p5", 1), ("p6", 1)):
        for _ in range(n):
            rows.append((t, "file_create", p, None, f"f{t}"))
            t += 1
    top = sorted(processes.top_processes(trace(spark, rows)).collect(), key=lambda r: r.rank)
    assert [r.process_id for r in top] == ["Process_Root", "Process_2", "Process_3", "Process_4", "Process_5"]
    assert top[0].is_root and top[-1].total_actions == 1
    assert top[0].action_text == "file_create: 5"


def test_invariants_on_lens(spark):
    from trailfold.plans.inputs import Inputs
    i = Inputs(spark, "/root/testdata/sf0.001")
    from pyspark.sql import functions as F
    m = i.trace.groupBy("experiment").agg(F.count(F.lit(1)).alias("M"))
    bg = sequence.bigrams(i.trace).groupBy("experiment").agg(F.sum("n").alias("B"))
    runs = sequence.rle_runs(i.trace).groupBy("experiment").agg(F.sum("run_len").alias("R"))
    j = m.join(bg, "experiment").join(runs, "experiment").collect()
    assert j and all(r.B == r.M - 1 and r.R == r.M for r in j)
    s = summary.trace_summary(i.trace).collect()
    for r in s:
        assert sum(r.rule_counts.values()) == r.total_events
        assert r.process_tree.max_tree_depth <= r.process_tree.total_processes + 1
