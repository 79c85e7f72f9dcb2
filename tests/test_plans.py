"""Physical-plan guards: no keyless joins anywhere, pruned scans of the landed table."""

import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_no_keyless_joins(spark):
    qs = E.queries()
    bad = {}
    for name in sorted(E.oracle_sql()):
        plan = _plan(qs[name](spark, SF))
        hits = [f for f in FORBIDDEN if f in plan]
        if hits:
            bad[name] = hits
    assert not bad, bad


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_landed_scan_is_pruned(spark):
    plan = _plan(E.queries()["rule_counts"](spark, SF))
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line]
    assert len(scans) == 1 and "ReadSchema: struct<experiment:string,RuleName:string>" in scans[0]
