"""Percentiles bring the counts that hold an asked rank to the driver, no others."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import labels as LB
from tessella.operators import learning as LN
from tessella.operators import many_fits as MF
from tessella.operators import quantiles as Q

PROBS = [0.0, 0.1, 0.5, 0.93, 1.0]


def collected(monkeypatch, frame):
    seen, plain = [], type(frame).collect
    monkeypatch.setattr(type(frame), "collect", lambda self: seen.append(plain(self)) or seen[-1])
    return seen


def test_counts_of_other_values_stay_with_the_tasks(spark, monkeypatch):
    rng = np.random.default_rng(11)
    close, wide = 1 + rng.random(6000) / 100, rng.normal(size=6000) * 10.0 ** rng.integers(-200, 200, 6000)
    few = rng.integers(-2, 3, 6000).astype(float)
    df = spark.createDataFrame(np.column_stack([close, wide, few, np.arange(6000) % 2]).tolist(), "a double, b double, c double, g double").repartition(3)
    seen = collected(monkeypatch, df)
    out = Q.percentiles(df, ["a", "b", "c"], PROBS, F.col("g"))
    assert seen and max(map(len, seen)) <= 2 * 3 * 2 * len(PROBS)  # groups, columns, ranks
    got = {(r.part, r.column_name, r.prob): r.value for r in out.collect()}
    assert len(got) == 2 * 3 * len(PROBS)
    for g in (0, 1):
        for name, x in (("a", close), ("b", wide), ("c", few)):
            for p in PROBS:
                assert got[g, name, p] == pytest.approx(np.quantile(x[g::2], p), rel=1e-12, abs=1e-300)


def test_nulls_nan_and_empty_columns(spark):
    rows = [(1.0, None, None), (float("nan"), 4.0, None), (None, -0.0, None), (3.0, 0.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r.column_name, r.prob): r.value for r in Q.percentiles(df, ["a", "b", "c"], [0.5, 1.0]).collect()}
    assert got == {("a", 0.5): 2.0, ("a", 1.0): 3.0, ("b", 0.5): 0.0, ("b", 1.0): 4.0}
    assert Q.percentiles(df, ["c"], [0.5]).collect() == Q.percentiles(df, ["a"], []).collect() == []


def test_groups_are_prepared_by_as_many_counts_as_medians(spark, monkeypatch):
    rng = np.random.default_rng(12)
    values = 1 + rng.random((4000, 2)) / 100
    df = spark.createDataFrame([(i % 2 + 1, i % 3 // 2, *map(float, v)) for i, v in enumerate(values)], "fold int, y int, a double, b double").repartition(3)
    seen = collected(monkeypatch, df)
    ready = MF.prepared_groups(df, "fold", ["a", "b"], "y")
    assert seen and max(map(len, seen)) <= 2 * 2 * 2  # groups, features, ranks of a median
    assert ready.count() == 4000


def test_predictions_of_folds_collect_sums_of_fits_at_most(spark, monkeypatch):
    rng = np.random.default_rng(13)
    rows = [
        (e, dt.date(2020 + t // 12, t % 12 + 1, 1), float(1 + rng.random() / 100), float(1 + rng.random() / 100), int(rng.random() < 0.4))
        for e in range(60) for t in range(30)
    ]
    df = spark.createDataFrame(rows, "e int, d date, a double, b double, y int").repartition(3)
    seen = collected(monkeypatch, df)
    out = LN.out_of_fold(LB.block_fold_rows(df, "d", 20, 3), ["a", "b"], "y", ["e", "d"], neg_ratio=2)
    assert seen and max(map(len, seen)) <= 3 * 4 * (1 + 3 + 9)  # folds, fits of a fold, loss with gradient and Hessian
    assert out.count() == 60 * 10
