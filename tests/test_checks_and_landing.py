"""Checks find seeded violations; landing, sinks and session keep what they say."""

import glob
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from helpers import det, pc, trace
from trailfold import session
from trailfold.functions.ranking import running_within
from trailfold.operators import checks, compare, counts, metrics, tree
from trailfold.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def n(df):
    return df.first().n_violations


def test_checks_see_seeded_violations(spark):
    two = spark.createDataFrame([("a", "benign"), ("a", "benign"), ("b", "odd")], "experiment string, label string")
    one = spark.createDataFrame([("a", "benign"), ("b", "malicious"), ("c", "benign")], "experiment string, label string")
    assert n(checks.dup_keys(two)) == 1 and n(checks.dup_keys(one)) == 0
    assert n(checks.label_domain_check(two)) == 2 and n(checks.label_domain_check(one)) == 0
    assert [r.experiment for r in checks.missing_features(one, two).collect()] == ["c"]
    assert n(checks.one_to_one_check(one, two)) == 1 and n(checks.one_to_one_check(one, one)) == 0
    x = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert n(checks.finite_check(x, ["v"])) == 3
    f = spark.createDataFrame([(0,), (9,), (10,), (-1,), (None,)], "fold int")
    assert n(checks.fold_range_check(f)) == 3
    h = spark.createDataFrame([("a" * 64,), ("A" * 64,), ("a" * 63,), (None,)], "prompt_hash string")
    assert n(checks.hash_format_check(h)) == 3
    s = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1)], "experiment string, shard_id int")
    assert n(counts.shard_span_check(s)) == 1
    c = spark.createDataFrame([("test",), ("test",)], "split string")
    assert {r.split: r.ok for r in checks.cohort_sizes(c, {"test": 2, "train": 1}).collect()} == {"test": True, "train": False}


def test_offsets_and_least_of_a_group(spark):
    t = trace(spark, [det(2.0), pc("root", "a", 2.5), pc("a", "b", 4.0)]).unionByName(trace(spark, [det(7.0)], "e2"))
    got = {(r.experiment, r.ingest_seq): r.offset_us for r in t.collect()}
    assert got == {("e1", 1): 0, ("e1", 2): 500_000, ("e1", 3): 2_000_000, ("e2", 1): 0}
    rows = spark.range(2000).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"), (5000 - F.col("id")).alias("v"))
    least = running_within(rows.repartition(7), ["g"], [F.col("o")], {}, least={"low": F.col("v")})
    assert {(r.g, r.low) for r in least.select("g", "low").distinct().collect()} == {(1999 % 3, 3001), (1998 % 3, 3002), (1997 % 3, 3003)}


def test_landed_files_are_sorted(spark, tmp_path):
    rows = [(f"e{i}", "detonation", i % 2) for i in range(40)]
    t = spark.createDataFrame(rows, "experiment string, RuleName string, shard_id int").select(
        "experiment", F.lit("2024-01-01").cast("timestamp").alias("timestamp"), "RuleName",
        *[F.lit(None).cast("string").alias(c) for c in ("parent_guid", "child_guid", "parent_name", "child_name")], "shard_id",
        F.monotonically_increasing_id().alias("file_pos"))
    out = str(tmp_path / "landed")
    back = readers.land_table(readers.land_events(t), out)
    assert back.count() == 40 and "offset_us" in back.columns
    files = glob.glob(f"{out}/shard_id=*/*.parquet")
    assert files
    for f in files:
        keys = [(r.experiment, r.ingest_seq) for r in spark.read.parquet(f).collect()]
        assert keys == sorted(keys)


def test_shard_numbers(spark):
    paths = ["/d/trees_0.json", "/d/trees_3.json/part-00000-a1-c000.json", "/d2/trees_12.json/part-00001.txt", "/d/none.json", "/d/trees.txt"]
    got = [r.s for r in spark.createDataFrame([(p,) for p in paths], "p string").select(readers.shard_of(F.col("p")).alias("s")).collect()]
    assert got == [0, 3, 12, None, None]


def test_sinks_keep_what_they_should(spark, tmp_path):
    audit = spark.createDataFrame([("a", "zero_shot"), ("b", "tool_agent")], "experiment_id string, config string")
    path = str(tmp_path / "audit")
    sinks.write_audit(audit, path)
    sinks.write_audit(audit.where("config = 'tool_agent'").withColumn("experiment_id", F.lit("c")), path)
    assert {(r.config, r.experiment_id) for r in spark.read.parquet(path).collect()} == {("zero_shot", "a"), ("tool_agent", "c")}
    with pytest.raises(ValueError):
        sinks.write_audit(audit.withColumn("label", F.lit("benign")), path)
    rec = spark.createDataFrame([("e", 0, '{"experiment_id": "e", "total_events": 3}', "t")],
                                "experiment_id string, shard_id int, json_data string, text_repr string")
    out = str(tmp_path / "jsonl")
    sinks.write_summary_jsonl(rec, out)
    line = "".join(open(f).read() for f in glob.glob(f"{out}/shard_id=0/*.json"))
    assert '"summary":{"experiment_id":"e"' in line.replace(" ", "")
    # another shard, and the first one again: each replaces its own folder only
    sinks.write_summary_jsonl(rec.withColumn("shard_id", F.lit(1)), out)
    sinks.write_summary_jsonl(rec.withColumn("text_repr", F.lit("new")), out)
    assert [(r.shard_id, r.text) for r in spark.read.json(out).orderBy("shard_id").collect()] == [(0, "new"), (1, "t")]
    rows = spark.range(1200).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("k"))
    got = sorted(int(r.k) for r in sinks.sample_rows(rows, "k").collect())
    assert got == [*range(50), 500, 1000]


def test_null_group_keeps_its_auc(spark):
    rows = [(None, "malicious", 0.9), (None, "benign", 0.1), (2024, "malicious", 0.2), (2024, "benign", 0.7)]
    df = spark.createDataFrame(rows, "year int, label string, malware_probability double").withColumn(
        "prediction", F.when(F.col("malware_probability") >= 0.5, "malicious").otherwise("benign"))
    got = {r.year: r.roc_auc for r in metrics.binary_metrics(df, ["year"]).collect()}
    assert got == {None: 1.0, 2024: 0.0}


def test_run_report_counts_failures(spark):
    rows = [("a", "malicious", 0.9, "success"), ("b", "benign", 0.2, "cached"), ("c", None, None, "exception: x"),
            ("d", None, None, "missing_trace_summary")]
    audit = spark.createDataFrame(rows, "experiment_id string, prediction string, malware_probability double, status string").select(
        "*", F.lit("zero_shot").alias("config"), F.lit("m").alias("model"), F.lit(2.0).alias("latency_sec"),
        F.when(F.col("status") == "success", 8).cast("long").alias("prompt_tokens"), F.lit(4).cast("long").alias("completion_tokens"))
    labels = spark.createDataFrame([("a", "malicious"), ("b", "malicious"), ("c", "benign"), ("d", "benign")], "experiment string, label string")
    r = compare.run_report(audit, labels).first()
    assert (r.expected, r.valid_predictions, r.failures, r.coverage, r.n, r.tp, r.fn) == (4, 2, 2, 0.5, 2, 1, 1)
    assert (r.avg_latency_sec, r.avg_prompt_tokens, r.avg_completion_tokens) == (2.0, 2.0, 4.0)


def test_depth_of_odd_graphs(spark):
    chain = [det()] + [pc("root" if i == 0 else f"n{i}", f"n{i + 1}", 1 + i / 100) for i in range(25)]
    dag = [det(), pc("root", "a"), pc("root", "b"), pc("a", "b"), pc("b", "c")]
    cycle = [det(), pc("root", "a"), pc("a", "b"), pc("b", "a"), pc("b", "root")]
    star = [det()] + [pc("root", f"s{i}") for i in range(30)]
    t = trace(spark, chain, "chain")
    for name, rows in (("dag", dag), ("cycle", cycle), ("star", star)):
        t = t.unionByName(trace(spark, rows, name))
    assert {r.experiment: r.max_tree_depth for r in tree.tree_depth(t).collect()} == {"chain": 26, "dag": 3, "cycle": 3, "star": 2}
    assert {r.experiment: r.max_tree_depth for r in tree.tree_depth_dfs(t).collect()} == {"chain": 26, "dag": 4, "cycle": 3, "star": 2}


def test_a_session_keeps_its_settings(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert session.get_session("local[2]").conf.get("spark.sql.shuffle.partitions") == "64"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_rates_read_offsets_without_a_join(spark):
    for name in ("peak_sliding", "trace_rates", "prov_edges", "relative_offsets"):
        plan = E.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        scans = plan.count("Relation [")
        assert scans <= (1 if name in ("prov_edges", "relative_offsets") else 4), (name, scans)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_summary_and_features_scan_the_trace_few_times(spark):
    from trailfold.operators import features, summary
    from trailfold.plans.inputs import Inputs
    landed = Inputs(spark, SF).trace
    for build, most in ((summary.trace_summary, 7), (features.all_features, 14)):
        plan = build(landed)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") <= most
