import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessella.operators import features as FE
from tessella.operators import labels as L
from tessella.operators import panel as P
from tessella.operators import series as S


def month(i):
    return dt.date(2020 + i // 12, i % 12 + 1, 1)


def facts(spark, spans):
    rows = [(e, month(i), float(i)) for e, months in spans.items() for i in months]
    return spark.createDataFrame(rows, "entity string, period date, v double")


def test_gap_rule_boundary(spark):
    f = facts(spark, {"five": range(0, 10), "six": range(0, 9), "alive": range(0, 15), "gap": [0, 14]})
    panel = P.flag_failures(P.build_panel({"x": f}, "entity", "period"), "entity", "period")
    assert panel.count() == 4 * 15
    got = {r.entity: r for r in P.entity_summary(panel, "entity", "period").collect()}
    assert got["five"].is_failed == 0 and got["five"].failure_date is None
    assert got["six"].is_failed == 1 and got["six"].failure_date == month(9)
    assert got["alive"].failure_date is None and got["gap"].failure_date is None
    assert got["gap"].present_observations == 2 and got["gap"].months_covered == 15
    quick = {r.entity: r.failure_date for r in P.silent_entities(f, "entity", "period").collect()}
    assert quick == {e: r.failure_date for e, r in got.items()}


def test_period_summary_rate(spark):
    f = facts(spark, {"a": [0, 1, 2], "b": [0]})
    panel = P.flag_failures(P.build_panel({"x": f}, "entity", "period"), "entity", "period")
    rates = {r.period: r.availability_rate for r in P.period_summary(panel, "entity", "period").collect()}
    assert rates == {month(0): 100.0, month(1): 50.0, month(2): 50.0}


def test_labels_around_failure(spark):
    days = [dt.date(2022, 12, 31), dt.date(2023, 1, 31), dt.date(2023, 2, 28)]
    df = spark.createDataFrame([(d, dt.date(2023, 2, 1)) for d in days] + [(days[0], None)], "d date, failure_date date")
    rows = L.early_warning_labels(df, "d", horizons=(1,)).orderBy("failure_date", "d").collect()
    assert [(r.will_fail_within_1m, r.post_failure) for r in rows] == [(0, False), (0, False), (1, False), (0, True)]


def test_rolling_min_periods(spark):
    df = spark.createDataFrame(
        [("a", month(i), v) for i, v in enumerate([1.0, None, 3.0, 5.0])] + [("b", month(i), float(i + 1)) for i in range(3)],
        "entity string, period date, v double",
    )
    out = FE.add_rolling(df, "entity", "period", ["v"], [3, 6]).orderBy("entity", "period").collect()
    assert [r.v_ma3 for r in out[:4]] == [1, 1, 2, 4]
    assert [r.v_std3 for r in out[:2]] == [None, None]
    assert out[2].v_std3 == pytest.approx(2**0.5) and out[3].v_std3 == pytest.approx(2**0.5)
    assert [r.v_ma6 for r in out[4:]] == [None, None, 2]


def test_slices_and_folds(spark):
    df = spark.createDataFrame([(month(i),) for i in range(13)], "d date")
    slices = [r["slice"] for r in L.period_slices(df, "d", 5).orderBy("month").collect()]
    assert slices == [0, 0, 1, 1, 1, 2, 2, 3, 3, 3, 4, 4, 4]  # edges 0 2 5 7 10 13
    folds = L.expanding_folds(df, "d", 10, 6).orderBy("fold").collect()
    assert [(r.fold, r.train_end.month, r.val_month.month) for r in folds] == [(1, 10, 11), (2, 11, 12), (3, 12, 1)]
    rows = L.fold_rows(df, "d", L.expanding_folds(df, "d", 10, 6))
    counts = {(r.fold, r.role): r["count"] for r in rows.groupBy("fold", "role").count().collect()}
    assert counts == {(1, "train"): 10, (1, "validate"): 1, (2, "train"): 11, (2, "validate"): 1,
                      (3, "train"): 12, (3, "validate"): 1}


def test_quarter_expansion_and_empty_month(spark):
    q = spark.createDataFrame([(dt.date(2019, 3, 31), 5.0)], "q date, value double")
    got = sorted(r.date for r in S.quarter_to_months(q, "q").collect())
    assert got == [dt.date(2019, 1, 31), dt.date(2019, 2, 28), dt.date(2019, 3, 31)]
    days = spark.createDataFrame([(dt.date(2020, 1, 3), 1.0), (dt.date(2020, 1, 9), 3.0), (dt.date(2020, 3, 1), 7.0)], "d date, v double")
    monthly = [(r.date, r.v) for r in S.daily_to_monthly(days, "d", "v").orderBy("date").collect()]
    assert monthly == [(dt.date(2020, 1, 31), 2.0), (dt.date(2020, 2, 29), None), (dt.date(2020, 3, 31), 7.0)]


def test_pct_change_spot_value(spark):
    y = spark.createDataFrame([("g", 2016, 2200.851), ("g", 2017, 2654.483), ("h", 2017, 1.0)], "s string, y int, v double")
    out = {(r.s, r.y): r.c for r in S.pct_change(y, ["s"], "y", "v", "c").collect()}
    assert out[("g", 2017)] == pytest.approx(20.61166339747671)
    assert out[("g", 2016)] is None and out[("h", 2017)] is None


def test_outer_merge_keeps_all_dates(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, `a.b` double")
    b = spark.createDataFrame([(2, 3.0), (3, 4.0)], "k int, c double")
    rows = [tuple(r) for r in S.outer_merge([a, b], "k").orderBy("k").collect()]
    assert rows == [(1, 1.0, None), (2, 2.0, 3.0), (3, None, 4.0)]


def test_blank_outside(spark):
    df = spark.createDataFrame([("a", month(i), float(v)) for i, v in enumerate([0, 5, 0, 7, 0])], "entity string, period date, v double")
    life = P.lifespan(df, "entity", "period", ["v"])
    assert [(r.start, r.end) for r in life.collect()] == [(month(1), month(3))]
    out = P.blank_outside(df, life, "entity", "period", ["v"], ["v"]).orderBy("period").collect()
    assert [r.v for r in out] == [None, 5.0, None, 7.0, None]


def test_coverage_lists_gaps(spark):
    df = spark.createDataFrame([(month(i),) for i in (0, 1, 4)], "d date")
    r = P.period_coverage(df, "d").first()
    assert (r.found_months, r.expected_months, r.missing_months) == (3, 5, "2020-03,2020-04")
    assert r.coverage_ratio == pytest.approx(0.6)


def test_zscore_and_scale_constant(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0)], "a double, b double")
    z = FE.zscore(df, ["a", "b"]).select(F.round("a_z", 6), "b_z").collect()
    assert sorted(tuple(r) for r in z) == [(-0.707107, 0.0), (0.707107, 0.0)]
    s = FE.apply_scale(df, FE.fit_scale(df, ["a", "b"]), ["a", "b"]).collect()
    assert sorted(tuple(r) for r in s) == [(-1.0, 0.0), (1.0, 0.0)]
