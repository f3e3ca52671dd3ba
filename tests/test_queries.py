"""Registered queries against DuckDB, and what their plans may not contain."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_oracle  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from tessella.plans import catalogue  # noqa: E402

SQL = {n: q for n, q in oracle_sql().items() if n in catalogue.QUERIES}
QUERIES = {n: f for n, f in queries().items() if n in catalogue.QUERIES}
EAGER = {n for n, f in QUERIES.items() if f.__module__.endswith((".models", ".streaming"))}


@pytest.fixture(scope="module")
def duck(sf):
    return check_oracle.duck(sf)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    cur = duck.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    got = check_oracle.canon(df.columns, [tuple(r) for r in df.collect()])
    assert got == check_oracle.canon(cols, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_cross_joins(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(
    "name,limits",
    # the top k are ranked within parts of a group and then within the group: two limits each
    [("first_record_per_period", 2), ("most_complete_row", 2), ("consolidated_variants", 2), ("top_k_per_period", 4)],
)
def test_group_limits_run_before_the_shuffle(spark, sf, name, limits):
    text = plan(QUERIES[name](spark, sf))
    assert text.count("WindowGroupLimit") == limits


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(QUERIES["membership_slice"](spark, sf))
    assert "GreaterThanOrEqual(o_orderdate" in text and "o_orderpriority" not in text


def test_entry(spark):
    assert entry(spark).count() > 0
