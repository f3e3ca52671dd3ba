"""Regression, classification, selection and scoring queries.

The supplier panel supplies features; the label marks a month whose next month
has an unusually high share of returns.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import calibration as CA
from tessella.operators import econometrics as EC
from tessella.operators import features as FE
from tessella.operators import labels as LB
from tessella.operators import learning as LN
from tessella.operators import many_fits as MF
from tessella.operators import quantiles as QT
from tessella.operators import ranking as RK
from tessella.plans.base import (
    CUSTOMER_MONTHS,
    CUSTOMER_PANEL,
    SUPPLIER_MONTHS,
    customer_months,
    customer_panel,
    query,
    r,
    rounded,
    supplier_months,
)

from tessella.session import materialize, scratch_path

E, D = "entity", "period"
FEATURES = ["price", "quantity", "tax_share", "discount_share", "returned_share", "price_lag1", "returned_share_ma3"]
CUT = "1999-12-01"


LABELLED = f"""{SUPPLIER_MONTHS}, s AS (SELECT entity, period, price, quantity, tax / price AS tax_share, discount / price AS discount_share,
  coalesce(returned, 0) / price AS returned_share FROM supplier_months),
labelled AS (SELECT s.*, b.price AS price_lag1,
  avg(s.returned_share) OVER (PARTITION BY s.entity ORDER BY s.period RANGE BETWEEN INTERVAL 2 MONTH PRECEDING AND CURRENT ROW) AS returned_share_ma3,
  CASE WHEN n.returned_share > 0.6 THEN 1 ELSE 0 END AS y, n.entity IS NOT NULL AS has_next
  FROM s LEFT JOIN s b ON b.entity = s.entity AND b.period = s.period - INTERVAL 1 MONTH
         LEFT JOIN s n ON n.entity = s.entity AND n.period = s.period + INTERVAL 1 MONTH)"""


def labelled_rows_of(spark, d):
    """Supplier months with features and ``y``, the next calendar month's label.

    Lags, windows and the label follow the calendar; months without a successor
    have no label and are left out.
    """
    m = supplier_months(spark, d)
    shares = m.select(
        E, D, "price", "quantity",
        (F.col("tax") / F.col("price")).alias("tax_share"),
        (F.col("discount") / F.col("price")).alias("discount_share"),
        (F.coalesce("returned", F.lit(0.0)) / F.col("price")).alias("returned_share"),
    )
    lagged = FE.add_rolling(FE.add_lags(shares, E, D, ["price"], [1]), E, D, ["returned_share"], [3])
    ahead = FE.add_lags(lagged, E, D, ["returned_share"], [-1]).withColumnRenamed("returned_share_lag-1", "ahead")
    rows = ahead.withColumn("y", (F.col("ahead") > 0.6).cast("int")).filter(F.col("y").isNotNull())
    return rows.select(E, D, *FEATURES, "y")


def labelled_panel(spark, d):
    """Model fits read the rows many times: written once, with fixed lineage."""
    return materialize(labelled_rows_of(spark, d), "labelled")


@query(
    "labelled_rows",
    f"WITH {LABELLED} SELECT entity, period, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURES)}, y FROM labelled WHERE has_next",
)
def labelled_rows(spark, d):
    """What all classifiers below are fitted on."""
    return rounded(labelled_rows_of(spark, d))


def prepared(spark, d, with_mean=True):
    rows = labelled_panel(spark, d)
    train, test = LB.time_split(rows, D, CUT)
    return LN.prepare(train, [train, test], FEATURES, with_mean)


# -------------------------------------------------------- panel regression

BALANCED = f"""{CUSTOMER_PANEL}, b AS (SELECT entity, period, coalesce(amount, 0) / 1000 AS y, CAST(coalesce(n_orders, 0) AS DOUBLE) AS x FROM panel),
d AS (SELECT entity, period, y - avg(y) OVER (PARTITION BY entity) - avg(y) OVER (PARTITION BY period) + avg(y) OVER () AS yd,
  x - avg(x) OVER (PARTITION BY entity) - avg(x) OVER (PARTITION BY period) + avg(x) OVER () AS xd FROM b)"""


def balanced(spark, d):
    return customer_panel(spark, d).select(
        E, D, (F.coalesce("amount", F.lit(0.0)) / 1000).alias("y"), F.coalesce("n_orders", F.lit(0)).cast("double").alias("x")
    )


@query("two_way_demeaned", f"WITH {BALANCED} SELECT entity, period, round(yd, 6) AS y_within, round(xd, 6) AS x_within FROM d")
def two_way_demeaned(spark, d):
    """on the rectangular panel the closed form must come out."""
    out = EC.two_way_demean(balanced(spark, d), E, D, ["y", "x"])
    return rounded(out.select(E, D, "y_within", "x_within"))


@query(
    "unbalanced_within_means",
    f"""WITH {CUSTOMER_MONTHS}, g AS (SELECT 'entity' AS side, CAST(entity AS VARCHAR) AS part, count(*) AS n FROM customer_months GROUP BY ALL
UNION ALL SELECT 'period', CAST(period AS VARCHAR), count(*) FROM customer_months GROUP BY ALL)
SELECT side, part, n, CAST(0 AS DOUBLE) AS amount_mean, CAST(0 AS DOUBLE) AS orders_mean FROM g""",
)
def unbalanced_within_means(spark, d):
    """F11 on the sparse customer months: every entity and period mean is zero.

    Zero group means and values that differ from the input by entity plus period
    effects define the solution; the second half is what the operator adds up.
    """
    m = customer_months(spark, d).select(E, D, "amount", F.col("n_orders").cast("double").alias("orders"))
    out = materialize(EC.two_way_demean(m, E, D, ["amount", "orders"]), "within")

    def means(side, key):
        def zero(c):
            return (F.round(F.avg(c), 6) + 0.0).alias(c.replace("within", "mean"))

        return out.groupBy(F.lit(side).alias("side"), F.col(key).cast("string").alias("part")).agg(
            F.count("*").alias("n"), zero("amount_within"), zero("orders_within")
        )

    return means("entity", E).unionByName(means("period", D))


@query(
    "removed_effects_add_up",
    f"""WITH {CUSTOMER_MONTHS}, s AS (SELECT period, lag(period) OVER (PARTITION BY entity ORDER BY period) AS earlier FROM customer_months)
SELECT period, count(*) AS n, CAST(0 AS DOUBLE) AS amount_spread, CAST(0 AS DOUBLE) AS orders_spread FROM s
WHERE earlier = period - INTERVAL 1 MONTH GROUP BY period""",
)
def removed_effects_add_up(spark, d):
    """what demeaning takes away is entity plus period effects.

    From one month to the next it then changes by the same amount for every
    entity.  With the zero means above this determines the solution.
    """
    m = customer_months(spark, d).select(E, D, "amount", F.col("n_orders").cast("double").alias("orders"))
    out = EC.two_way_demean(m, E, D, ["amount", "orders"])
    w = Window.partitionBy(E).orderBy(D)

    def step(c):
        taken = F.col(c) - F.col(f"{c}_within")
        return (taken - F.lag(taken).over(w)).alias(c)

    steps = out.select(D, F.lag(D).over(w).alias("earlier"), step("amount"), step("orders"))
    steps = steps.filter(F.col("earlier") == F.add_months(D, -1))

    def spread(c):
        return (F.round(F.max(c) - F.min(c), 5) + 0.0).alias(f"{c}_spread")

    return steps.groupBy(D).agg(F.count("*").alias("n"), spread("amount"), spread("orders"))


@query(
    "panel_regression",
    f"""WITH {BALANCED}, c AS (SELECT sum(xd * yd) / sum(xd * xd) AS beta, sum(xd * xd) AS sxx, sum(yd * yd) AS syy, count(*) AS n, count(DISTINCT entity) AS g FROM d),
s AS (SELECT entity, sum(xd * (yd - beta * xd)) AS s FROM d, c GROUP BY 1),
m AS (SELECT sum(s * s) AS meat FROM s), e AS (SELECT sum((yd - beta * xd) * (yd - beta * xd)) AS rss FROM d, c)
SELECT 'x' AS term, round(beta, 6) AS coef, round(sqrt(meat / (sxx * sxx) * g / (g - 1)), 6) AS std_err, round(1 - rss / syy, 6) AS r2_within,
  n AS nobs, g AS entities FROM c, m, e""",
)
def panel_regression(spark, d):
    """K9 with one regressor, clustered by entity."""
    out = EC.panel_ols(balanced(spark, d), "y", ["x"], E, D)
    return rounded(out.select("term", "coef", "std_err", "r2_within", "nobs", "entities"))


@query("panel_regression_variants")
def panel_regression_variants(spark, d):
    """Financial, macro (absorbed by period effects), both, enhanced."""
    rows = labelled_panel(spark, d).withColumn("log_price", F.ln("price")).withColumn("macro", F.month(D).cast("double"))
    fin, macro = ["tax_share", "discount_share"], ["macro"]
    groups = {"financial": fin, "macro": macro, "both": fin + macro, "enhanced": fin + ["price_lag1", "log_price"]}
    return EC.panel_variants(rows, "returned_share", E, D, groups)


@query(
    "panel_variant_coefficients",
    f"""WITH {CUSTOMER_PANEL}, b AS (SELECT entity, period, coalesce(amount, 0) / 1000 AS y, CAST(coalesce(n_orders, 0) AS DOUBLE) AS x FROM panel),
c AS (SELECT *, x * x AS z FROM b),
d AS (SELECT y - avg(y) OVER e - avg(y) OVER t + avg(y) OVER () AS y, x - avg(x) OVER e - avg(x) OVER t + avg(x) OVER () AS x,
  z - avg(z) OVER e - avg(z) OVER t + avg(z) OVER () AS z FROM c WINDOW e AS (PARTITION BY entity), t AS (PARTITION BY period)),
s AS (SELECT count(*) AS n, sum(x * x) AS xx, sum(x * z) AS xz, sum(z * z) AS zz, sum(x * y) AS xy, sum(z * y) AS zy FROM d)
SELECT 'one' AS model, 'x' AS term, round(xy / xx, 5) AS coef, n AS nobs FROM s
UNION ALL SELECT 'both', 'x', round((xy * zz - xz * zy) / (xx * zz - xz * xz), 5), n FROM s
UNION ALL SELECT 'both', 'x2', round((xx * zy - xz * xy) / (xx * zz - xz * xz), 5), n FROM s""",
)
def panel_variant_coefficients(spark, d):
    """Two variable lists on the rectangular panel."""
    rows = balanced(spark, d).withColumn("x2", F.col("x") * F.col("x"))
    out = EC.panel_variants(rows, "y", E, D, {"one": ["x"], "both": ["x", "x2"]})
    return out.select("model", "term", F.round("coef", 5).alias("coef"), "nobs")


# --------------------------------------------------- per-entity regressions

OLS = f"""{SUPPLIER_MONTHS}, x AS (SELECT entity, period, coalesce(returned, 0) AS y, price AS x1, quantity * 1000 AS x2 FROM supplier_months),
g AS (SELECT entity, count(*) AS n, sum(x1 * x1) AS a, sum(x1 * x2) AS b, sum(x2 * x2) AS c, sum(x1 * y) AS u, sum(x2 * y) AS v
  FROM x WHERE period <= DATE '{CUT}' GROUP BY 1 HAVING count(*) >= 12),
k AS (SELECT entity, n, (u * c - b * v) / (a * c - b * b) AS b1, (a * v - b * u) / (a * c - b * b) AS b2 FROM g)"""


def ols_rows(spark, d):
    m = supplier_months(spark, d)
    return m.select(
        E, D, F.coalesce("returned", F.lit(0.0)).alias("y"), F.col("price").alias("x1"), (F.col("quantity") * 1000).alias("x2")
    )


def ols_coefs(spark, d):
    train, _ = LB.time_split(ols_rows(spark, d), D, CUT)
    return EC.grouped_ols(train, E, "y", ["x1", "x2"])


@query("entity_regressions", f"WITH {OLS} SELECT entity, n, round(b1, 6) AS b1, round(b2, 6) AS b2 FROM k")
def entity_regressions(spark, d):
    """Least squares without intercept per entity."""
    c = ols_coefs(spark, d)
    return rounded(c.select(E, "n", F.col("coef")[0].alias("b1"), F.col("coef")[1].alias("b2")))


@query(
    "entity_regression_scores",
    f"WITH {OLS} SELECT x.entity, period, round(coalesce(b1 * x1 + b2 * x2, 0), 3) AS score FROM x LEFT JOIN k ON k.entity = x.entity WHERE period > DATE '{CUT}'",
)
def entity_regression_scores(spark, d):
    """Test rows scored with their own features."""
    _, test = LB.time_split(ols_rows(spark, d), D, CUT)
    out = EC.score_grouped(test, ols_coefs(spark, d), E, ["x1", "x2"], "score")
    return rounded(out.select(E, D, "score"), 3)


@query(
    "scores_of_known_entities",
    f"""WITH {OLS} SELECT x.entity, period, round(b1 * x1 + b2 * x2, 3) AS score FROM x JOIN k ON k.entity = x.entity
WHERE period > DATE '{CUT}' AND k.entity % 3 <> 0""",
)
def scores_of_known_entities(spark, d):
    """Entities without a model are skipped."""
    _, test = LB.time_split(ols_rows(spark, d), D, CUT)
    known = ols_coefs(spark, d).filter("entity % 3 <> 0")
    return rounded(EC.lookup_score(test, known, E, ["x1", "x2"], "score").select(E, D, "score"), 3)


@query(
    "residual_autoregression",
    f"""WITH {SUPPLIER_MONTHS}, x AS (SELECT entity, period, CASE WHEN coalesce(returned, 0) / price > 0.4 THEN 1 ELSE 0 END AS y,
  round(least(0.9, quantity / 1000), 4) AS p, CASE WHEN period <= DATE '{CUT}' THEN 'train' ELSE 'test' END AS split FROM supplier_months),
a AS (SELECT *, CASE WHEN split = 'train' THEN y - p END AS rr FROM x),
b AS (SELECT *, max(rr) OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN INTERVAL 1 MONTH PRECEDING AND INTERVAL 1 MONTH PRECEDING) AS lg,
  last_value(rr IGNORE NULLS) OVER (PARTITION BY entity ORDER BY period ROWS UNBOUNDED PRECEDING) AS lastr,
  count(*) FILTER (WHERE split = 'test') OVER (PARTITION BY entity ORDER BY period ROWS UNBOUNDED PRECEDING) AS h FROM a),
f AS (SELECT entity, sum(rr * lg) / nullif(sum(lg * lg) FILTER (WHERE split = 'train'), 0) AS phi, count(*) FILTER (WHERE split = 'train') AS n FROM b GROUP BY 1),
o AS (SELECT b.*, CASE WHEN n >= 8 THEN coalesce(CASE WHEN split = 'train' THEN phi * lg ELSE pow(phi, h) * lastr END, 0) ELSE 0 END AS res FROM b JOIN f USING (entity))
SELECT entity, period, split, round(res, 6) AS residual_forecast, round(greatest(least(p + res, 1), 0), 6) AS adjusted FROM o""",
)
def residual_autoregression(spark, d):
    """K12, B24."""
    m = supplier_months(spark, d)
    share = F.coalesce("returned", F.lit(0.0)) / F.col("price")
    x = m.select(
        E, D, (share > 0.4).cast("int").alias("y"), F.round(F.least(F.lit(0.9), F.col("quantity") / 1000), 4).alias("p")
    )
    out = EC.residual_ar(LB.split_tag(x, D, CUT), E, D, "y", "p", "split")
    return rounded(out.select(E, D, "split", "residual_forecast", "adjusted"))


SCORE_AT = f"""{SUPPLIER_MONTHS}, l AS (SELECT entity, period, coalesce(returned, 0) / price AS y, max(price) OVER (w RANGE BETWEEN INTERVAL 1 MONTH PRECEDING AND INTERVAL 1 MONTH PRECEDING) AS l1, max(price) OVER (w RANGE BETWEEN INTERVAL 2 MONTH PRECEDING AND INTERVAL 2 MONTH PRECEDING) AS l2
  FROM supplier_months WINDOW w AS (PARTITION BY entity ORDER BY period)),
f AS (SELECT * FROM l WHERE l1 IS NOT NULL AND l2 IS NOT NULL),
s AS (SELECT avg(l1) AS m1, stddev_pop(l1) AS s1, avg(l2) AS m2, stddev_pop(l2) AS s2 FROM f WHERE period <= DATE '{CUT}'),
z AS (SELECT entity, period, y, (l1 - m1) / s1 AS z1, (l2 - m2) / s2 AS z2 FROM f, s),
g AS (SELECT entity, sum(z1 * z1) AS a, sum(z1 * z2) AS b, sum(z2 * z2) AS c, sum(z1 * y) AS u, sum(z2 * y) AS v FROM z
  WHERE period <= DATE '{CUT}' GROUP BY 1 HAVING count(*) >= 12),
k AS (SELECT entity, (u * c - b * v) / (a * c - b * b) AS b1, (a * v - b * u) / (a * c - b * b) AS b2 FROM g)"""


@query(
    "scored_at_latest_date",
    f"""WITH {SCORE_AT} SELECT z.entity, z.period, round(greatest(least(b1 * z1 + b2 * z2, 1), 0), 6) AS prob_fail FROM z JOIN k USING (entity)
WHERE z.period = (SELECT max(period) FROM f WHERE entity % 2 = 0) AND z.entity % 2 = 0""",
)
def scored_at_latest_date(spark, d):
    """Lagged, scaled scoring at the latest date for a list of entities."""
    m = supplier_months(spark, d).select(E, D, "price", (F.coalesce("returned", F.lit(0.0)) / F.col("price")).alias("y"))
    cols = ["price_lag1", "price_lag2"]
    lagged = FE.add_lags(m, E, D, ["price"], [1, 2]).na.drop(subset=cols)
    train, _ = LB.time_split(lagged, D, CUT)
    stats = FE.fit_scale(train, cols)
    coefs = EC.grouped_ols(FE.apply_scale(train, stats, cols), E, "y", cols)
    wanted = m.select(E).distinct().filter("entity % 2 = 0")
    return rounded(LN.score_at(m, coefs, stats, E, D, ["price"], [1, 2], entities=wanted))


# ------------------------------------------------------------- classifiers


@query("logistic_predictions")
def logistic_predictions(spark, d):
    """L1 logistic fitted on train, predictions with split tag."""
    train, test = prepared(spark, d)
    fit = LN.fit_logistic(train, FEATURES, "y", c=1.0, l1=True)
    both = fit.score(train).withColumn("split", F.lit("train")).unionByName(
        fit.score(test).withColumn("split", F.lit("test"))
    )
    return both.select(E, D, "split", "y", "p")


@query("boosted_tree_predictions")
def boosted_tree_predictions(spark, d):
    """K8."""
    train, test = prepared(spark, d)
    return LN.fit_gbt(train, FEATURES, "y", rounds=10).score(test).select(E, D, "y", "p")


@query("penalty_selection")
def penalty_selection(spark, d):
    """K7: ten penalties over five expanding folds by mean ROC-AUC."""
    rows = labelled_panel(spark, d)
    n_months = rows.select(F.last_day(D)).distinct().count()
    folds = LB.block_fold_rows(rows, D, n_months // 6, 5)
    return LN.cv_select(folds, FEATURES, "y", [10.0**k for k in range(-4, 6)], metric="roc_auc", l1=True)


MONTH_NUMBERS = """l AS (SELECT entity, period, y FROM labelled WHERE has_next),
mo AS (SELECT mo, row_number() OVER (ORDER BY mo) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT last_day(period) AS mo FROM l))"""


@query(
    "penalty_grid_optimality",
    f"""WITH {LABELLED}, {MONTH_NUMBERS},
b AS (SELECT mo, greatest(CAST(floor((idx - n // 6) * 5.0 / greatest(n - n // 6, 1)) AS INTEGER) + 1, 0) AS blk FROM mo),
f AS (SELECT CAST(r.fold AS VARCHAR) AS group_name, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives
  FROM l JOIN b ON b.mo = last_day(period) JOIN (SELECT unnest(range(1, 6)) AS fold) r ON b.blk < r.fold GROUP BY 1),
c AS (SELECT unnest([0.0001, 0.01, 1.0, 100.0]) AS c)
SELECT group_name, c.c::DOUBLE AS c, n, positives, CAST(0 AS DOUBLE) AS violation FROM f, c""",
)
def penalty_grid_optimality(spark, d):
    """K7: every fit of the grid is optimal for the train rows of its fold."""
    rows = labelled_panel(spark, d)
    n_months = rows.select(F.last_day(D)).distinct().count()
    folds = LB.block_fold_rows(rows, D, n_months // 6, 5)
    ready = MF.prepared_groups(folds, "fold", FEATURES, "y", train=F.col("role") == "train")
    every = tuple(range(len(FEATURES)))
    fits = MF.fit_many(ready, "fold", [MF.Fit(k, c, True, every) for k in range(1, 6) for c in (0.0001, 0.01, 1.0, 100.0)])
    out = MF.optimality(ready, "fold", fits).select("group_name", "c", "n", "positives", "violation")
    return out.withColumn("violation", F.round("violation", 6) + 0.0)


@query(
    "train_fit_optimality",
    f"""WITH {LABELLED}, t AS (SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM labelled WHERE has_next AND period <= DATE '{CUT}')
SELECT k.size, k.l1, n, positives, CAST(0 AS DOUBLE) AS violation FROM t, (VALUES (2, true), (4, true), (7, true), (7, false)) k(size, l1)""",
)
def train_fit_optimality(spark, d):
    """The sparse fit, the ridge fit and refits on fewer features."""
    train, _ = LB.time_split(labelled_panel(spark, d), D, CUT)
    ready = MF.prepared_groups(train.withColumn("all", F.lit(0)), "all", FEATURES, "y")
    every = tuple(range(len(FEATURES)))
    first = MF.fit_many(ready, "all", [MF.Fit(0, 1.0, True, every)])[0]
    ranked = tuple(sorted(every, key=lambda j: (-abs(first.coef[j]), FEATURES[j])))
    fits = MF.fit_many(ready, "all", [MF.Fit(0, 1.0, True, ranked[:k]) for k in (2, 4, 7)] + [MF.Fit(0, 1.0, False, every)])
    out = MF.optimality(ready, "all", fits).select("size", (F.col("fit") < 3).alias("l1"), "n", "positives", "violation")
    return out.withColumn("violation", F.round("violation", 6) + 0.0)


@query(
    "slice_fit_optimality",
    f"""WITH {LABELLED}, {MONTH_NUMBERS}, sl AS (SELECT mo, len(list_filter(range(5), lambda i: floor(i * n / 5.0) <= idx)) - 1 AS slice FROM mo)
SELECT CAST(slice AS VARCHAR) AS group_name, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, CAST(0 AS DOUBLE) AS violation
FROM l JOIN sl ON sl.mo = last_day(period) GROUP BY 1""",
)
def slice_fit_optimality(spark, d):
    """The sparse fits of the time slices."""
    rows = labelled_panel(spark, d)
    slices = LB.period_slices(rows, D, 5)
    sliced = rows.withColumn("month", F.last_day(D)).join(F.broadcast(slices), "month")  # one row per month
    ready = MF.prepared_groups(sliced, "slice", FEATURES, "y", with_mean=False)
    every = tuple(range(len(FEATURES)))
    numbers = [x["slice"] for x in slices.select("slice").distinct().orderBy("slice").collect()]  # five
    fits = MF.fit_many(ready, "slice", [MF.Fit(k, 1.0, True, every) for k in numbers])
    out = MF.optimality(ready, "slice", fits).select("group_name", "n", "positives", "violation")
    return out.withColumn("violation", F.round("violation", 6) + 0.0)


@query("score_augmented_fit")
def score_augmented_fit(spark, d):
    """The per-entity regression score joins the features, then a refit."""
    train, test = prepared(spark, d)
    coefs = EC.grouped_ols(train, E, "y", FEATURES)
    wide = [*FEATURES, "entity_score"]
    tr, te = (EC.score_grouped(f, coefs, E, FEATURES, "entity_score") for f in (train, test))
    return LN.fit_logistic(tr, wide, "y", l1=True).score(te).select(E, D, "y", "entity_score", "p")


@query("coefficient_importance")
def coefficient_importance(spark, d):
    """Coefficients ranked by size."""
    train, _ = prepared(spark, d)
    return LN.coefficients(LN.fit_logistic(train, FEATURES, "y", l1=True))


@query("top_feature_sweep")
def top_feature_sweep(spark, d):
    """Refits on the k most important features."""
    train, test = prepared(spark, d)
    train, test = materialize(train, "train"), materialize(test, "test")
    ranked = LN.coefficients(LN.fit_logistic(train, FEATURES, "y", l1=True))
    names = [x["feature"] for x in ranked.orderBy("rank").collect()]  # one row per feature
    return LN.sweep_top_k(train, test, names, "y", [2, 4, 7])


@query("refits_at_three_splits")
def refits_at_three_splits(spark, d):
    """The same fit at three split dates, metrics side by side."""
    from tessella.operators.metrics import quality_metrics

    cuts = ("1998-06-01", "1999-06-01", "2000-06-01")
    rows = labelled_panel(spark, d).withColumn("split_date", F.explode(F.array(*map(F.lit, cuts))))
    early = F.col(D) <= F.col("split_date").cast("date")
    ready = MF.prepared_groups(rows, "split_date", FEATURES, "y", train=early, written=True)
    fits = MF.fit_many(ready, "split_date", [MF.Fit(cut, 1.0, True, tuple(range(len(FEATURES)))) for cut in cuts])
    scored = MF.score_many(ready.filter("not is_train"), "split_date", fits)
    return quality_metrics(scored.select(F.col("label").alias("y"), "p", "split_date"), "y", "p", ["split_date"])


@query("stable_features")
def stable_features(spark, d):
    """K15."""
    return LN.stability_select(labelled_panel(spark, d), D, FEATURES, "y")


@query("wald_table")
def wald_table(spark, d):
    """K18."""
    train, _ = prepared(spark, d)
    fit = LN.fit_logistic(train, FEATURES, "y", c=1e6, balanced=False)
    return EC.logit_wald(train, FEATURES, list(fit.model.coefficients), fit.model.intercept)


COARSE = f"""{SUPPLIER_MONTHS}, x AS (SELECT CASE WHEN period <= DATE '{CUT}' THEN 'train' ELSE 'test' END AS split,
  CASE WHEN coalesce(returned, 0) / price > 0.4 THEN 1 ELSE 0 END AS y, least(90, floor(quantity / 10)) / 100 AS p FROM supplier_months)"""


def coarse_scores(spark, d):
    m = supplier_months(spark, d)
    share = F.coalesce("returned", F.lit(0.0)) / F.col("price")
    p = F.least(F.lit(90), F.floor(F.col("quantity") / 10)) / 100
    return LB.split_tag(m.select(E, D, (share > 0.4).cast("int").alias("y"), p.alias("p")), D, CUT)


@query(
    "wald_table_one_feature",
    f"""WITH RECURSIVE {COARSE}, nr AS (
  SELECT 0 AS k, 0::DOUBLE AS b0, 0::DOUBLE AS b1
  UNION ALL
  SELECT k + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  FROM (SELECT k, b0, b1, sum(y - q) AS g0, sum((y - q) * p) AS g1, sum(q * (1 - q)) AS h00, sum(q * (1 - q) * p) AS h01, sum(q * (1 - q) * p * p) AS h11
    FROM (SELECT nr.*, x.y, x.p, 1 / (1 + exp(-(b0 + b1 * x.p))) AS q FROM nr, x WHERE k < 12 AND split = 'train') GROUP BY k, b0, b1)),
e AS (SELECT b1, sum(q * (1 - q)) AS h00, sum(q * (1 - q) * p) AS h01, sum(q * (1 - q) * p * p) AS h11
  FROM (SELECT nr.*, x.p, 1 / (1 + exp(-(b0 + b1 * x.p))) AS q FROM nr, x WHERE k = 12 AND split = 'train') GROUP BY b1)
SELECT 'p' AS term, round(b1, 5) AS coef, round(sqrt(h00 / (h00 * h11 - h01 * h01)), 5) AS std_err FROM e""",
)
def wald_table_one_feature(spark, d):
    """Coefficient and Wald error of one feature, unpenalised in effect."""
    train = coarse_scores(spark, d).filter("split = 'train'")
    ready = materialize(
        train.select(F.lit(0).alias("all"), F.col("y").alias("label"), F.lit(True).alias("is_train"), F.lit(1.0).alias("weight"), F.array("p").alias("x")), "wald"
    )
    fit = MF.fit_many(ready, "all", [MF.Fit(0, 1e12, False, (0,))])[0]
    table = EC.logit_wald(train, ["p"], [float(b) for b in fit.coef], fit.intercept)
    return table.filter("term = 'p'").select("term", F.round("coef", 5).alias("coef"), F.round("std_err", 5).alias("std_err"))


def _oof(spark, d):
    """Every month from the sixty-first on is scored, by a fit of earlier months."""
    return LN.out_of_fold(LB.block_fold_rows(labelled_panel(spark, d), D, 60, 6), FEATURES, "y", [E, D], neg_ratio=3)


@query("out_of_fold_predictions")
def out_of_fold_predictions(spark, d):
    """Calibrated ensemble per expanding fold."""
    return _oof(spark, d)


@query("out_of_fold_metrics")
def out_of_fold_metrics(spark, d):
    """Fold metrics from one pass."""
    from tessella.operators.metrics import quality_metrics

    return quality_metrics(_oof(spark, d), "y", "p", ["fold"])


@query("next_month_watch_list")
def next_month_watch_list(spark, d):
    """H3: the latest labelled month, ranked by a fit of all months before it."""
    rows = labelled_panel(spark, d)
    n_months = rows.select(F.last_day(D)).distinct().count()
    folds = LB.block_fold_rows(rows, D, n_months - 1, 1)
    return RK.watch_list(LN.out_of_fold(folds, FEATURES, "y", [E, D], neg_ratio=3), D, [F.desc("p"), F.asc(E)], 10)


@query("saved_model_scores")
def saved_model_scores(spark, d):
    """A fit is saved as tables, loaded, and scores raw test rows; the
    direct score of the prepared rows stands beside it."""
    rows = labelled_panel(spark, d)
    train, test = LB.time_split(rows, D, CUT)
    tr, te = LN.prepare(train, [train, test], FEATURES)
    fit = LN.fit_logistic(tr, FEATURES, "y")
    cal = LN.platt(LN.out_of_fold_scores(tr, FEATURES, "y"), "y", "raw")
    medians = QT.percentiles(train, FEATURES, [0.5]).select(F.col("column_name").alias("feature"), F.col("value").alias("median"))
    filled = FE.apply_impute(train, FE.fit_impute(train, FEATURES), FEATURES)
    stats = filled.unpivot([], FEATURES, "feature", "value").groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation")
    )
    path = scratch_path(spark, "saved-model")
    LN.save_linear(fit, stats, medians, cal, path)
    saved = LN.score_saved(test, path, "saved").select(E, D, "saved")
    direct = cal.score(fit.score(te, "raw"), "direct").select(E, D, "direct")
    both = direct.join(saved, [E, D])
    return both.select(E, D, F.round("direct", 6).alias("direct"), F.round("saved", 6).alias("saved"))


@query("isotonic_calibration")
def isotonic_calibration(spark, d):
    """Steps fitted on scores of later months, saved, reloaded and applied."""
    rows = labelled_panel(spark, d)
    train, test = LB.time_split(rows, D, CUT)
    tr, te = LN.prepare(train, [train, test], FEATURES)
    fit = LN.fit_logistic(tr, FEATURES, "y")
    later = LN.later_scores(train, D, FEATURES, "y", [E, D], first=24)
    path = scratch_path(spark, "steps")
    CA.fit_steps(later, "y", "raw").write.parquet(path)
    return CA.apply_steps(fit.score(te).select(E, D, "y", "p"), spark.read.parquet(path), "p")


STEPS = f"""{SUPPLIER_MONTHS}, x AS (SELECT entity, period, CASE WHEN coalesce(returned, 0) / price > 0.4 THEN 1 ELSE 0 END AS y,
  least(90, floor(quantity / 10)) / 100 AS p FROM supplier_months),
g AS (SELECT p, count(*) AS n, sum(y) AS pos FROM x WHERE period <= DATE '{CUT}' GROUP BY p),
s AS (SELECT p, n, pos, row_number() OVER o AS i, sum(n) OVER o AS cn, sum(pos) OVER o AS cp FROM g WINDOW o AS (ORDER BY p)),
m AS (SELECT a.i AS a, b.i AS b, (b.cp - a.cp + a.pos) / (b.cn - a.cn + a.n) AS mean FROM s a JOIN s b ON a.i <= b.i),
t AS (SELECT s.i, a, min(mean) AS least FROM s JOIN m ON a <= s.i AND b >= s.i GROUP BY 1, 2),
v AS (SELECT p, v FROM (SELECT i, max(least) AS v FROM t GROUP BY i) JOIN s USING (i)),
w AS (SELECT q.p, max(v.p) FILTER (WHERE v.p <= q.p) AS lo, min(v.p) FILTER (WHERE v.p >= q.p) AS hi
  FROM (SELECT DISTINCT p FROM x) q, v GROUP BY q.p)
SELECT entity, period, x.p, round(CASE WHEN lo IS NULL THEN h.v WHEN hi IS NULL OR lo = hi THEN l.v
  ELSE l.v + (h.v - l.v) * (w.p - lo) / (hi - lo) END, 6) AS calibrated
FROM x JOIN w ON w.p = x.p LEFT JOIN v l ON l.p = lo LEFT JOIN v h ON h.p = hi WHERE period > DATE '{CUT}'"""


@query("isotonic_steps", f"WITH {STEPS}")
def isotonic_steps(spark, d):
    """A saved and reloaded monotone step table on coarse scores."""
    m = supplier_months(spark, d)
    share = F.coalesce("returned", F.lit(0.0)) / F.col("price")
    x = m.select(E, D, (share > 0.4).cast("int").alias("y"), (F.least(F.lit(90), F.floor(F.col("quantity") / 10)) / 100).alias("p"))
    train, test = LB.time_split(x, D, CUT)
    path = scratch_path(spark, "steps")
    CA.fit_steps(train, "y", "p").write.parquet(path)
    return rounded(CA.apply_steps(test.select(E, D, "p"), spark.read.parquet(path), "p"))


@query("metric_table")
def metric_table(spark, d):
    """Metrics written as nested JSON and read as a long table."""
    from tessella.operators.metrics import quality_metrics
    from tessella.sources.files import save_json

    train, test = prepared(spark, d)
    fit = LN.fit_logistic(train, FEATURES, "y")
    both = fit.score(train).select("y", "p", F.lit("train").alias("split")).unionByName(
        fit.score(test).select("y", "p", F.lit("test").alias("split"))
    )
    m = quality_metrics(both, "y", "p", ["split"])
    names = ["roc_auc", "average_precision", "brier"]
    path = save_json(m.select("split", F.struct(*names).alias("metrics")), scratch_path(spark, "metrics"))
    back = spark.read.schema("split string, metrics struct<roc_auc:double,average_precision:double,brier:double>").json(path)
    return back.select("split", "metrics.*").unpivot(["split"], names, "metric", "value")


@query(
    "score_metric_table",
    f"""WITH {COARSE}, g AS (SELECT split, p, sum(y) AS pos, count(*) - sum(y) AS neg FROM x GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(pos + neg) OVER w AS n, sum(neg) OVER w - neg AS above,
  sum(pos) OVER (PARTITION BY split) AS all_pos, sum(neg) OVER (PARTITION BY split) AS all_neg FROM g WINDOW w AS (PARTITION BY split ORDER BY p DESC)),
m AS (SELECT split, sum(pos * (all_neg - above - neg / 2)) / (max(all_pos) * max(all_neg)) AS roc_auc, sum(pos / all_pos * tp / n) AS average_precision FROM c GROUP BY split),
b AS (SELECT split, avg((p - y) * (p - y)) AS brier FROM x GROUP BY split)
SELECT split, 'roc_auc' AS metric, round(roc_auc, 6) AS value FROM m UNION ALL SELECT split, 'average_precision', round(average_precision, 6) FROM m
UNION ALL SELECT split, 'brier', round(brier, 6) FROM b""",
)
def score_metric_table(spark, d):
    """Metrics of a coarse score, written as nested JSON and read as a long table."""
    from tessella.operators.metrics import quality_metrics
    from tessella.sources.files import save_json

    m = quality_metrics(coarse_scores(spark, d).select("y", "p", "split"), "y", "p", ["split"])
    names = ["roc_auc", "average_precision", "brier"]
    path = save_json(m.select("split", F.struct(*names).alias("metrics")), scratch_path(spark, "metrics"))
    back = spark.read.schema("split string, metrics struct<roc_auc:double,average_precision:double,brier:double>").json(path)
    return rounded(back.select("split", "metrics.*").unpivot(["split"], names, "metric", "value"))
