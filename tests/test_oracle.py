"""Every S-oracle query against DuckDB on the smallest driver tables; entry smoke."""

import os

import pytest

import __spark_entry__ as E
from trailfold.plans import catalog
from oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"
SLOW = {"ablation", "gbt_predict", "oof_predict"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_oracle_query(spark, con, name):
    res = compare(spark, SF, [name], con=con, verbose=False)[name]
    assert res[0] == "OK", res


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == E.entry(spark).columns


def test_every_query_has_a_builder():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    own = catalog.queries()
    assert set(own) <= set(q) and set(catalog.oracle_sql()) <= set(s)
    # names like op1_ and the pipeline belong to the optional subpackage
    assert not any(n.startswith("op") and n[2:3].isdigit() or n == "pipeline" for n in own)
