import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import econometrics as EC
from tessella.operators import learning as LN


def unbalanced(seed=4, entities=30, months=20):
    rng = np.random.default_rng(seed)
    rows = []
    for e in range(entities):
        for t in range(months):
            if rng.random() < 0.3:
                continue
            x1, x2 = rng.normal(), rng.normal() + 0.1 * e
            y = 2 * x1 - 0.5 * x2 + 0.3 * e + 0.2 * t + rng.normal()
            rows.append((e, dt.date(2020 + t // 12, t % 12 + 1, 1), float(y), float(x1), float(x2), float(t)))
    return rows


def test_panel_ols_equals_dummy_regression(spark):
    rows = unbalanced()
    df = spark.createDataFrame(rows, "e int, d date, y double, x1 double, x2 double, t double")
    got = {r.term: r for r in EC.panel_ols(df, "y", ["x1", "x2", "t"], "e", "d").collect()}
    assert set(got) == {"x1", "x2"}  # t is absorbed by the period effects
    es, ds = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    X = np.array([[r[3], r[4], *[r[0] == e for e in es], *[r[1] == d for d in ds[1:]]] for r in rows], float)
    y = np.array([r[2] for r in rows])
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    assert got["x1"].coef == pytest.approx(beta[0], abs=1e-7)
    assert got["x2"].coef == pytest.approx(beta[1], abs=1e-7)
    assert got["x1"].nobs == len(rows) and got["x1"].entities == len(es)
    D = X[:, 2:]
    within = X[:, :2] - D @ np.linalg.lstsq(D, X[:, :2], rcond=None)[0]
    u = y - X @ beta
    bread = np.linalg.inv(within.T @ within)
    s = np.array([sum(within[i] * u[i] for i in range(len(rows)) if rows[i][0] == e) for e in es])
    n, g = len(rows), len(es)
    cov = bread @ (s.T @ s) @ bread * (g / (g - 1)) * ((n - 1) / (n - 2))
    assert got["x1"].std_err == pytest.approx(np.sqrt(cov[0, 0]), rel=1e-6)


def test_demeaned_residuals_have_no_group_means(spark):
    df = spark.createDataFrame(unbalanced(9), "e int, d date, y double, x1 double, x2 double, t double")
    out = EC.two_way_demean(df, "e", "d", ["y"])
    for key in ("e", "d"):
        worst = out.groupBy(key).agg(F.avg("y_within").alias("m")).agg(F.max(F.abs("m"))).first()[0]
        assert worst < 1e-8


def test_a_long_chain_of_short_entities_is_solved(spark):
    """120 entities of two months each, chained over 121 months."""
    rng = np.random.default_rng(1)
    months = [dt.date(2000 + t // 12, t % 12 + 1, 1) for t in range(121)]
    rows = [(e, months[e + k], float(1e9 + rng.normal() + 5 * e)) for e in range(120) for k in (0, 1)]
    rows += [(500 + e, dt.date(1990, 1 + k, 1), float(rng.normal())) for e in range(3) for k in (0, 1)]  # unconnected
    df = spark.createDataFrame(rows, "e int, d date, y double")
    out = EC.two_way_demean(df, "e", "d", ["y"])
    for key in ("e", "d"):
        worst = out.groupBy(key).agg(F.avg("y_within").alias("m")).agg(F.max(F.abs("m"))).first()[0]
        assert worst < 1e-6  # of values near 1e9


def test_demeaning_refuses_nulls(spark):
    df = spark.createDataFrame([(1, dt.date(2020, 1, 1), None), (1, dt.date(2020, 2, 1), 1.0)], "e int, d date, y double")
    with pytest.raises(ValueError, match="nulls"):
        EC.two_way_demean(df, "e", "d", ["y"])


def test_tails_equal_tabulated_values():
    assert EC.t_tail(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert EC.t_tail(12.706205, 1) == pytest.approx(0.05, abs=1e-6)
    assert EC.f_tail(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert EC.f_tail(3.325835, 5, 10) == pytest.approx(0.05, abs=1e-6)
    assert EC.t_tail(1.959964, 1e7) == pytest.approx(0.05, abs=1e-6)


def test_r2_can_be_negative(spark):
    rows = [(e, d, 100.0 * e + y, x1, x2, t) for e, d, y, x1, x2, t in unbalanced(5)]
    df = spark.createDataFrame(rows, "e int, d date, y double, x1 double, x2 double, t double")
    got = {r.term: r for r in EC.panel_ols(df, "y", ["x1"], "e", "d").collect()}["x1"]
    ys, xs = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    assert got.r2_total == pytest.approx(1 - ((ys - got.coef * xs) ** 2).sum() / (ys**2).sum())
    assert 0 <= got.f_p_value <= 1 and got.r2_within > got.r2_total


def test_too_few_rows_gives_no_result(spark):
    df = spark.createDataFrame(unbalanced(2, 4, 5), "e int, d date, y double, x1 double, x2 double, t double")
    assert EC.panel_ols(df, "y", ["x1"], "e", "d").count() == 0


def test_grouped_ols_equals_lstsq(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for e in range(5):
        n = 8 if e == 4 else 20
        X = rng.normal(size=(n, 3))
        X[:, 2] = X[:, 0] if e == 0 else X[:, 2]  # collinear: minimum norm
        y = X @ [1, 2, 3] + rng.normal(size=n)
        want[e] = np.linalg.lstsq(X, y, rcond=None)[0]
        rows += [(e, float(b), *map(float, a)) for a, b in zip(X, y)]
    df = spark.createDataFrame(rows, "e int, y double, a double, b double, c double")
    got = {r.e: r.coef for r in EC.grouped_ols(df, "e", "y", ["a", "b", "c"]).collect()}
    assert set(got) == {0, 1, 2, 3}  # the short one has no fit
    for e, coef in got.items():
        assert coef == pytest.approx(want[e], abs=1e-8)


def test_residual_ar_short_history_unchanged(spark):
    rows = [("a", i, 1 if i % 3 == 0 else 0, 0.3, "train" if i < 9 else "test") for i in range(12)]
    rows += [("b", i, 1, 0.4, "train" if i < 5 else "test") for i in range(8)]
    df = spark.createDataFrame(rows, "e string, t int, y int, p double, s string")
    out = {(r.e, r.t): r for r in EC.residual_ar(df, "e", "t", "y", "p", "s").collect()}
    assert all(out[("b", i)].adjusted == 0.4 for i in range(8))
    r = np.array([(1 if i % 3 == 0 else 0) - 0.3 for i in range(9)])
    phi = (r[1:] @ r[:-1]) / (r[:-1] @ r[:-1])
    assert out[("a", 10)].residual_forecast == pytest.approx(phi**2 * r[-1])
    assert all(0 <= x.adjusted <= 1 for x in out.values())


def test_logistic_l1_drops_noise_and_wald(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    p = 1 / (1 + np.exp(-(2 * x[:, 0])))
    y = (rng.random(600) < p).astype(int)
    df = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y)], "a double, b double, c double, y int")
    sparse = LN.fit_logistic(df, ["a", "b", "c"], "y", c=0.02, l1=True)
    coef = list(sparse.model.coefficients)
    assert abs(coef[0]) > 0.1 and abs(coef[1]) < 1e-6 and abs(coef[2]) < 1e-6
    full = LN.fit_logistic(df, ["a", "b", "c"], "y", c=1e6, balanced=False)
    w = {r.term: r for r in EC.logit_wald(df, ["a", "b", "c"], list(full.model.coefficients), full.model.intercept).collect()}
    assert w["a"].significant and w["a"].p_value < 1e-6
    X = np.column_stack([np.ones(600), x])
    z = X @ [full.model.intercept, *full.model.coefficients]
    q = 1 / (1 + np.exp(-z))
    se = np.sqrt(np.diag(np.linalg.inv((X * (q * (1 - q))[:, None]).T @ X)))
    assert w["b"].std_err == pytest.approx(se[2], rel=1e-6)
    ranks = [r.feature for r in LN.coefficients(sparse).orderBy("rank").collect()]
    assert ranks[0] == "a"


def test_scores_survive_an_observed_session(spark):
    from pyspark.sql import Observation

    seen = Observation("o")
    spark.range(3).observe(seen, F.count("*").alias("n")).count()
    df = spark.createDataFrame([(float(i), int(i > 10 or i % 4 == 0)) for i in range(30)], "a double, y int")
    fit = LN.fit_logistic(df, ["a"], "y")
    p = [r.p for r in fit.score(df).orderBy("a").collect()]
    b0, b1 = fit.model.intercept, fit.model.coefficients[0]
    assert p == pytest.approx([1 / (1 + np.exp(-(b0 + b1 * i))) for i in range(30)])


def test_fits_made_together_equal_single_fits(spark):
    from tessella.operators import many_fits as MF

    rng = np.random.default_rng(8)
    rows = []
    for g in range(3):
        x = rng.normal(size=(300, 3)) * [1, 5, 0.1] + [0, 10, 0]
        y = rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] * (g - 1) + x[:, 2] * 3)))
        rows += [(g, *[None if rng.random() < 0.05 else float(v) for v in a], int(b), bool(rng.random() < 0.8)) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double, y int, tr boolean").repartition(5)
    names = ["a", "b", "c"]
    ready = MF.prepared_groups(df, "g", names, "y", train=F.col("tr"))
    grid = [MF.Fit(g, c, l1, kept) for g in range(3) for c, l1, kept in [(0.05, True, (0, 1, 2)), (1.0, True, (0, 2)), (1.0, False, (0, 1, 2)), (1e4, True, (0, 1, 2))]]
    fits = MF.fit_many(ready, "g", grid)
    for fit in fits:
        part = df.filter(F.col("g") == fit.group)
        (train,) = LN.prepare(part.filter("tr"), [part.filter("tr")], names)
        alone = LN.fit_logistic(train, [names[j] for j in fit.kept], "y", c=fit.c, l1=fit.l1)
        assert fit.coef == pytest.approx(list(alone.model.coefficients), abs=2e-4)
        assert fit.intercept == pytest.approx(alone.model.intercept, abs=2e-4)
    worst = MF.optimality(ready, "g", fits).agg(F.max("violation")).first()[0]
    assert worst < 1e-8
    scored = MF.score_many(ready.filter("not is_train"), "g", fits)
    assert scored.count() == 4 * df.filter("not tr").count()


def test_steps_equal_isotonic_regression(spark):
    from pyspark.ml.regression import IsotonicRegression
    from tessella.operators import calibration as CA

    rng = np.random.default_rng(4)
    p = np.round(rng.random(700) * 1.2 - 0.1, 3)
    y = (rng.random(700) < np.clip(p, 0, 1) ** 2).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int").repartition(6)
    steps = CA.fit_steps(df, "y", "p")
    rows = sorted((r.score, r.value) for r in steps.collect())
    assert [v for _, v in rows] == sorted(v for _, v in rows) and 2 < len(rows) < 300
    own = df.select(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "p")).alias("features"), F.col("y").cast("double").alias("label"))
    want = {round(r.features, 6): r.prediction for r in IsotonicRegression().fit(own).transform(own).collect()}
    path = __import__("tessella.session", fromlist=["x"]).scratch_path(spark, "steps")
    steps.write.parquet(path)
    got = CA.apply_steps(df.select("p").unionByName(spark.createDataFrame([(None,)], "p double")), spark.read.parquet(path), "p").collect()
    for r in got:
        if r.p is None:
            assert r.calibrated is None
        else:
            assert r.calibrated == pytest.approx(want[round(min(max(r.p, 0), 1), 6)], abs=1e-9)
    none = CA.apply_steps(df.limit(3), steps.limit(0), "p").collect()
    assert len(none) == 3 and all(r.calibrated is None for r in none)
