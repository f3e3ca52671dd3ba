"""Failure flags and lags of a panel come from the entity's row, without a sort."""

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import panel as P
from tessella.plans import catalogue


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flags_and_lags_equal_those_of_windows(spark):
    day = datetime.date
    a = [("a", day(2020, 1, 1), 1.0), ("a", day(2020, 3, 1), None), ("b", day(2020, 9, 1), 3.0), ("c", day(2020, 4, 1), 4.0), (None, day(2020, 2, 1), 5.0), ("e", None, 6.0)]
    b = [("a", day(2020, 2, 1), 7), ("d", day(2020, 3, 1), 8)]
    facts = {
        "x": spark.createDataFrame(a, "entity string, period date, v double"),
        "y": spark.createDataFrame(b, "entity string, period date, w long"),
    }
    plain = P.build_panel(facts, "entity", "period")
    w = Window.partitionBy("entity").orderBy("period")
    want = P.flag_failures(plain, "entity", "period").withColumns({
        "v_before": F.lag("v").over(w), "w_before": F.lag("w").over(w), "panel_start": F.lit(day(2020, 1, 1)),
    })
    got = P.build_panel(facts, "entity", "period", min_gap=6, lagged=("v", "w"))
    assert got.columns == want.columns
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)
    assert {r.entity for r in got.where("failed = 1").collect()} == {"a", "d"}
    assert "Window" not in _plan(got) and "Exchange" not in _plan(got).split("Subquery")[0]


def test_model_ready_rows_do_not_sort_the_panel(spark, sf):
    assert "Window" not in _plan(catalogue.QUERIES["model_ready_rows"](spark, sf))
