"""Queries that SQL can express, beside that SQL in DuckDB."""

import os
import sys

import pytest

from tessella.llm.catalogue import ORACLES, QUERIES

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import check_oracle  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    cur = check_oracle.duck(sf).execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    got = check_oracle.canon(df.columns, [tuple(r) for r in df.collect()])
    assert got == check_oracle.canon(cols, cur.fetchall())


@pytest.mark.parametrize("name", ["op1_quality_rules", "op7_secret_scans"])
def test_native_operators_run_no_python(spark, sf, name):
    text = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in text for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))
