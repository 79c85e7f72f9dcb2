"""Sources, sinks and the incremental summary stream on tiny files."""

import json
import os
import tempfile

from trailfold.sources import readers, sinks
from trailfold.streaming.summary_stream import start_summary_stream


def _write_shard(d, i, exps):
    rows = []
    for e in exps:
        rows.append({"experiment": e, "timestamp": "2024-01-01 00:00:00.000", "RuleName": "detonation",
                     "parent_guid": None, "child_guid": "r", "parent_name": None, "child_name": "s.exe"})
        rows.append({"experiment": e, "timestamp": "2024-01-01 00:00:01.500", "RuleName": "process_create",
                     "parent_guid": "r", "child_guid": "c", "parent_name": None, "child_name": "c.exe"})
        rows.append({"experiment": e, "timestamp": "2024-01-01 00:00:02.000", "RuleName": "net_connect",
                     "parent_guid": "c", "child_guid": None, "parent_name": None, "child_name": "1.2.3.4:443"})
    with open(os.path.join(d, f"trees_{i}.json"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows))


def test_labels_and_shards(spark):
    d = tempfile.mkdtemp(prefix="tf-io-")
    with open(os.path.join(d, "train.json"), "w") as f:
        f.write('{"experiment": "a", "label": "benign", "year": 2017.0}\n{"experiment": "b", "label": "malicious"}\n')
    with open(os.path.join(d, "test.json"), "w") as f:
        f.write('{"experiment": "c", "label": "malicious", "year": 2024.0}\n')
    lab = {r.experiment: r for r in readers.load_labels(spark, f"{d}/train.json", f"{d}/test.json").collect()}
    assert lab["a"].year == 2017 and lab["b"].year is None and lab["c"].test and not lab["a"].test
    _write_shard(d, 0, ["e1", "e2"])
    _write_shard(d, 3, ["e3"])
    t = readers.read_trace_shards(spark, [f"{d}/trees_0.json", f"{d}/trees_3.json"])
    rows = t.collect()
    assert {r.shard_id for r in rows if r.experiment == "e3"} == {3}
    assert sorted(r.ingest_seq for r in rows if r.experiment == "e1") == [1, 2, 3]


def test_stream_builds_store(spark):
    d = tempfile.mkdtemp(prefix="tf-stream-")
    src = os.path.join(d, "in")
    os.makedirs(src)
    _write_shard(src, 0, ["e1", "e2"])
    _write_shard(src, 1, ["e3"])
    store = os.path.join(d, "store")
    q = start_summary_stream(spark, src, store, os.path.join(d, "ckpt"))
    q.awaitTermination(300)
    s = readers.read_summary_store(spark, store).collect()
    assert sorted(r.experiment_id for r in s) == ["e1", "e2", "e3"]
    r = [x for x in s if x.experiment_id == "e1"][0]
    assert r.data.process_tree.max_tree_depth == 2 and r.data.entity_counts.unique_network_connections == 1
    assert "Root Process Direct Children: 1" in r.text_repr


def test_upsert_and_manifest(spark):
    cur = spark.createDataFrame([("a", 1, "old"), ("b", 1, "x")], "k string, v int, s string")
    upd = spark.createDataFrame([("a", 2, "new")], "k string, v int, s string")
    got = {r.k: r.s for r in sinks.upsert(cur, upd, "k", "v").collect()}
    assert got == {"a": "new", "b": "x"}
    d = tempfile.mkdtemp(prefix="tf-man-")
    p = os.path.join(d, "x.txt")
    with open(p, "w") as f:
        f.write("hello")
    m = sinks.manifest(spark, [p], {"trees": 200}, [p]).collect()
    kinds = {r.kind for r in m}
    assert kinds == {"input", "code", "meta"}
    assert [r.value for r in m if r.kind == "input"] == ["5"]


def test_templates_read_whole(spark):
    from trailfold.functions import prompts
    d = tempfile.mkdtemp(prefix="tf-tmpl-")
    paths = []
    for n, t in (("system_prompt", prompts.SYSTEM_PROMPT), ("zero_shot_user_prompt", prompts.ZERO_SHOT_USER)):
        p = os.path.join(d, f"{n}.txt")
        with open(p, "w") as f:
            f.write(t)
        paths.append(p)
    rows = readers.read_templates(spark, paths).collect()
    assert len(rows) == 2
    assert {r.template for r in rows} == {prompts.SYSTEM_PROMPT, prompts.ZERO_SHOT_USER}


def test_csv_round_trips(spark):
    from pyspark.sql import functions as F
    from trailfold.operators import compare, metrics
    from trailfold.plans.inputs import Inputs
    from trailfold.operators.counts import feature_matrix
    i = Inputs(spark, "/root/testdata/sf0.001")
    fm = feature_matrix(i.trace, i.labels)
    d = tempfile.mkdtemp(prefix="tf-csv-")
    sinks.write_feature_matrix(fm, os.path.join(d, "features"), fmt="csv")          # SNK-01
    back = readers.read_feature_csv(spark, os.path.join(d, "features"))             # SRC-03
    assert back.count() == fm.count() and back.exceptAll(fm.select(*back.columns)).count() == 0
    paths = {}
    for m in ("rf", "zs"):                                                           # SNK-02 / SRC-04
        p = i.model(m).withColumn("config", F.lit(m))
        sinks.write_predictions(p.drop("config"), os.path.join(d, f"pred_{m}"), partition_by=None)
        p.drop("config").coalesce(1).write.option("header", True).csv(os.path.join(d, f"csv_{m}"))
        paths[m] = os.path.join(d, f"csv_{m}")
    models = readers.read_predictions(spark, paths)
    assert models["rf"].count() == i.model("rf").count()
    matched = compare.matched_join(models)
    assert matched.count() > 0
    a = metrics.binary_metrics(models["rf"].where(metrics.valid_mask(models["rf"])))
    b = compare.disagreement(matched, "rf", "zs")
    stacked = sinks.stack_metrics(a.withColumn("kind", F.lit("m")), b.withColumn("kind", F.lit("d")))  # SNK-03
    assert stacked.count() == 2 and "both_correct" in stacked.columns and "roc_auc" in stacked.columns
