"""Keyed tables: upserts touch changed groups only, probes do not shuffle the table."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from trailfold.operators import scoring
from trailfold.session import checkpoint_dir
from trailfold.sources import keyed

SCHEMA = "k string, v int, s string"


@pytest.fixture
def table(spark):
    name = f"kt_{uuid.uuid4().hex}"
    path = os.path.join(checkpoint_dir(spark).replace("file:", ""), name)
    keyed.create(spark, name, path, spark.createDataFrame([], SCHEMA).schema, "k", groups=8, buckets=4)
    yield name, path
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def put(spark, name, rows):
    return keyed.upsert(spark, name, spark.createDataFrame(rows, SCHEMA), ["v"])


def held(spark, name):
    return {r.k: (r.v, r.s) for r in keyed.rows(spark, name).collect()}


def test_upsert_rewrites_changed_groups_only(spark, table):
    name, path = table
    first = [(f"key{i}", 1, "a") for i in range(60)]
    put(spark, name, first + [("key3", 0, "older"), (None, 1, "no key")])
    want = {k: (v, s) for k, v, s in first}
    assert held(spark, name) == want
    before = files(path)
    changed = put(spark, name, [("key7", 2, "b"), ("key7", 3, "c"), ("key8", 0, "late"), ("fresh", 1, None)])
    want |= {"key7": (3, "c"), "fresh": (1, None)}
    assert held(spark, name) == want and len(changed) <= 3
    kept = {f for f in before if not any(f"key_group={g}/" in f for g in changed)}
    assert kept and kept <= files(path) and not (before - kept) & files(path)
    assert put(spark, name, [("key7", 3, "c")]) and held(spark, name) == want       # again: nothing changes
    assert put(spark, name, [("key7", 3, "d")]) and held(spark, name)["key7"] == (3, "d")   # equal: the new one
    assert put(spark, name, []) == [] and put(spark, name, [(None, 9, "x")]) == []


def test_a_table_that_lies_there_is_taken_as_it_is(spark, table):
    name, path = table
    put(spark, name, [("a", 1, "x")])
    spark.sql(f"DROP TABLE {name}")
    keyed.create(spark, name, path, spark.createDataFrame([], SCHEMA).schema, "k", groups=8, buckets=4)
    assert held(spark, name) == {"a": (1, "x")}


def test_probe_and_upsert_do_not_shuffle_the_table(spark, table):
    name, _ = table
    put(spark, name, [(f"key{i}", 1, "success" if i % 2 else "api_error") for i in range(40)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.range(50).select(F.concat(F.lit("key"), "id").alias("k"), "id")
        out = keyed.missing(spark, name, asked, F.col("s") == "success")
        assert above_scan(out) == [False]
        assert {r.id for r in out.collect()} == {i for i in range(50) if i >= 40 or i % 2 == 0}
        updates = spark.createDataFrame([("key1", 2, "x")], SCHEMA)
        assert above_scan(keyed.merged(spark, name, updates, ["v"], list(range(8)))) == [False]
        # the cache's own readers, too: the latest of each key is found without moving the table
        cache = keyed.rows(spark, name).withColumnsRenamed({"k": "cache_key", "v": "timestamp", "s": "status"})
        assert above_scan(scoring.pending_rows(asked.withColumnRenamed("k", "cache_key"), cache)) == [False]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def above_scan(df):
    """For each scan of a table: whether a shuffle stands between it and the join above."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    found = []
    for i, line in enumerate(lines):
        if "FileScan parquet" in line:
            at, shuffled = depth(line), False
            for above in reversed(lines[:i]):
                if depth(above) < at:
                    at = depth(above)
                    if "Join" in above:
                        break
                    shuffled |= "Exchange" in above
            found.append(shuffled)
    return found
