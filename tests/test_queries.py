"""Every registered query against SQL for its answer."""

import os
from datetime import datetime

import pytest

import __spark_entry__ as entry_point
from quoteflow.plans.catalog import QUERIES
from quoteflow.plans.oracle import oracle

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    cells = lambda r: tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order)
    return sorted((cells(r) for r in rows), key=repr), sorted(columns)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    answer = duck.sql(oracle()[name])
    got, want = normal(df.collect(), df.columns), normal(answer.fetchall(), answer.columns)
    assert got[1] == want[1]
    assert got[0] == want[0]
    assert got[0], "a query without rows shows nothing"


def test_every_query_has_sql_and_a_plain_name():
    assert set(QUERIES) == set(oracle())
    assert set(QUERIES) <= set(entry_point.queries()) and set(oracle()) <= set(entry_point.oracle_sql())


def test_entry_runs(spark):
    df = entry_point.entry(spark)
    assert df.columns[:2] == ["source", "received"] and df.count() == 3


def test_result_types_compare_across_engines(spark):
    assert not any(isinstance(v, datetime) for v in entry_point.queries()["flow_snapshot"](spark, SF).first())
