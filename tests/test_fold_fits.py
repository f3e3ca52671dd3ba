"""Folds are sampled, prepared and fitted together, with the results of each alone."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import features as FE
from tessella.operators import labels as LB
from tessella.operators import learning as LN
from tessella.operators import many_fits as MF

NAMES = ["a", "b"]


def panel(spark, entities=25, months=30):
    rng = np.random.default_rng(6)
    rows = []
    for e in range(entities):
        for t in range(months):
            a, b = rng.normal(), 3 + 2 * rng.normal()
            y = int(rng.random() < 1 / (1 + np.exp(1 - a - 0.3 * b)))
            rows.append((e, dt.date(2020 + t // 12, t % 12 + 1, 1), None if rng.random() < 0.05 else float(a), float(b), y))
    return spark.createDataFrame(rows, "e int, d date, a double, b double, y int").repartition(3)


def test_groups_are_sampled_as_each_alone(spark):
    folds = LB.block_fold_rows(panel(spark), "d", 20, 3).filter("role = 'train'")
    together = FE.downsample_negatives(folds, "y", ["e", "d"], 1, 7, ["fold"]).select("fold", "e", "d", "y").collect()
    alone = [
        r for k in (1, 2, 3)
        for r in FE.downsample_negatives(folds.filter(F.col("fold") == k), "y", ["e", "d"], 1, 7).select("fold", "e", "d", "y").collect()
    ]
    assert len(together) > 300 and sorted(together) == sorted(alone)


def test_calibrated_fits_of_folds_equal_those_of_each_alone(spark):
    folds = LB.block_fold_rows(panel(spark), "d", 20, 3).filter("role = 'train'")
    ready = MF.prepared_groups(folds, "fold", NAMES, "y")
    linear, steps = LN._calibrators(ready, [1, 2, 3], (0, 1))
    for k, fit, step in zip((1, 2, 3), linear, steps):
        own = ready.filter(F.col("fold") == k).select(F.col("label").alias("y"), *[F.col("x")[j].alias(n) for j, n in enumerate(NAMES)])
        alone = LN.fit_logistic(own, NAMES, "y")
        assert fit.coef == pytest.approx(list(alone.model.coefficients), abs=2e-4)
        assert fit.intercept == pytest.approx(alone.model.intercept, abs=2e-4)
        platt = LN.platt(LN.out_of_fold_scores(own, NAMES, "y"), "y", "raw")
        assert step.coef[0] == pytest.approx(platt.model.coefficients[0], abs=2e-3)
        assert step.intercept == pytest.approx(platt.model.intercept, abs=2e-3)


def test_predictions_of_folds_need_no_fit_of_one_fold(spark, monkeypatch):
    """Linear fits and samples of all folds share their passes."""
    sampled, plain = [], LN.downsample_negatives
    monkeypatch.setattr(LN, "downsample_negatives", lambda *a: sampled.append(1) or plain(*a))
    monkeypatch.setattr(LN, "fit_logistic", lambda *a, **named: pytest.fail("a fold is fitted alone"))
    folds = LB.block_fold_rows(panel(spark), "d", 20, 3)
    out = LN.out_of_fold(folds, NAMES, "y", ["e", "d"], neg_ratio=2).collect()
    assert len(out) == 25 * 10 and len(sampled) == 1
    assert all(0 < r.p < 1 for r in out) and {r.fold for r in out} == {1, 2, 3}
    assert np.mean([r.p for r in out if r.y == 1]) > np.mean([r.p for r in out if r.y == 0])


def test_medians_of_groups_are_selected_in_as_many_columns_as_features(spark, monkeypatch):
    wide, plain = [], MF.percentiles
    monkeypatch.setattr(MF, "percentiles", lambda df, cols, *rest: wide.append(len(cols)) or plain(df, cols, *rest))
    folds = LB.block_fold_rows(panel(spark), "d", 20, 3)
    MF.prepared_groups(folds, "fold", NAMES, "y", train=F.col("role") == "train")
    assert wide == [2]


def test_a_group_of_one_class_has_an_infinite_intercept(spark):
    rows = [(1, 1, float(i)) for i in range(5)] + [(2, 0, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "g int, y int, a double")
    ready = MF.prepared_groups(df, "g", ["a"], "y")
    fits = MF.fit_many(ready, "g", [MF.Fit(1, 1.0, False, (0,)), MF.Fit(2, 1.0, False, (0,))])
    scored = MF.score_many(ready, "g", fits).collect()
    assert all(r.p == r.label for r in scored)


def test_refits_at_split_dates_share_their_passes(spark, sf, monkeypatch):
    from tessella.plans import models

    monkeypatch.setattr(LN, "fit_logistic", lambda *a, **named: pytest.fail("a split is fitted alone"))
    assert models.refits_at_three_splits(spark, sf).count() == 3
