"""Feature, label, fold and preprocessing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import features as FE
from tessella.operators import labels as LB
from tessella.operators.quantiles import percentiles
from tessella.plans.base import (
    CUSTOMER_PANEL,
    SCORED,
    SUPPLIER_MONTHS,
    customer_panel,
    query,
    r,
    rounded,
    scored_documents,
    supplier_months,
    table,
)

E, D = "entity", "period"


@query(
    "lagged_features",
    f"""WITH {CUSTOMER_PANEL}
SELECT entity, period, lag(amount, 1) OVER w AS amount_lag1, lag(amount, 3) OVER w AS amount_lag3,
  lag(present, 1) OVER w AS present_lag1, lag(present, 3) OVER w AS present_lag3
FROM panel WINDOW w AS (PARTITION BY entity ORDER BY period)""",
)
def lagged_features(spark, d):
    """F1; on the rectangular panel row lags are calendar lags."""
    out = FE.add_lags(customer_panel(spark, d), E, D, ["amount", "present"], [1, 3])
    return out.select(E, D, "amount_lag1", "amount_lag3", "present_lag1", "present_lag3")


def _rolling_sql(col: str, w: int) -> str:
    frame = f"OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN INTERVAL {w - 1} MONTH PRECEDING AND CURRENT ROW)"
    enough = f"count({col}) {frame} >= {max(1, w // 2)}"
    return (
        f"round(CASE WHEN {enough} THEN avg({col}) {frame} END, 4) AS {col}_ma{w}, "
        f"round(CASE WHEN {enough} THEN stddev_samp({col}) {frame} END, 4) AS {col}_std{w}"
    )


@query(
    "rolling_features",
    f"""WITH {SUPPLIER_MONTHS} SELECT entity, period, {_rolling_sql('price', 3)}, {_rolling_sql('price', 6)},
  {_rolling_sql('returned', 3)}, {_rolling_sql('returned', 6)} FROM supplier_months""",
)
def rolling_features(spark, d):
    """all windows share one shuffle and one sort."""
    m = supplier_months(spark, d).select(E, D, "price", "returned")
    out = FE.add_rolling(m, E, D, ["price", "returned"], [3, 6]).drop("price", "returned")
    return rounded(out, 4)


@query(
    "cumulative_amount",
    f"""WITH {SUPPLIER_MONTHS} SELECT entity, period, round(sum(quantity) OVER (PARTITION BY entity ORDER BY period ROWS UNBOUNDED PRECEDING), 2) AS running_quantity
FROM supplier_months""",
)
def cumulative_amount(spark, d):
    """F4."""
    from pyspark.sql import Window

    w = Window.partitionBy(E).orderBy(D).rowsBetween(Window.unboundedPreceding, 0)
    return supplier_months(spark, d).select(E, D, r(F.sum("quantity").over(w), 2).alias("running_quantity"))


@query(
    "standardized_measures",
    f"""WITH {SUPPLIER_MONTHS}, s AS (SELECT avg(price) AS mp, stddev_samp(price) AS sp, avg(returned) AS mr, stddev_samp(returned) AS sr FROM supplier_months)
SELECT entity, period, round((price - mp) / sp, 6) AS price_z, round((returned - mr) / sr, 6) AS returned_z, 0.0::DOUBLE AS constant_z FROM supplier_months, s""",
)
def standardized_measures(spark, d):
    """F9."""
    m = supplier_months(spark, d).withColumn("constant", F.lit(7.0))
    return rounded(FE.zscore(m, ["price", "returned", "constant"]).select(E, D, "price_z", "returned_z", "constant_z"))


@query(
    "early_warning_labels",
    f"""WITH {CUSTOMER_PANEL}, m AS (SELECT *, last_day(period) AS date_m FROM panel)
SELECT entity, date_m, coalesce(date_m >= failure_date, FALSE) AS post_failure,
  CAST(coalesce(date_m < failure_date AND failure_date <= CAST(date_m + INTERVAL 1 MONTH AS DATE), FALSE) AS INTEGER) AS will_fail_within_1m,
  CAST(coalesce(date_m < failure_date AND failure_date <= CAST(date_m + INTERVAL 6 MONTH AS DATE), FALSE) AS INTEGER) AS will_fail_within_6m FROM m""",
)
def early_warning_labels(spark, d):
    """F7."""
    p = customer_panel(spark, d).withColumn("date_m", F.last_day(D))
    return LB.early_warning_labels(p, "date_m").select(
        E, "date_m", "post_failure", "will_fail_within_1m", "will_fail_within_6m"
    )


@query(
    "model_ready_rows",
    f"""WITH {CUSTOMER_PANEL}, m AS (SELECT *, last_day(period) AS date_m FROM panel), l AS (
SELECT entity, date_m, strftime(date_m, '%Y-%m') AS year_month,
  CAST(coalesce(date_m < failure_date AND failure_date <= CAST(date_m + INTERVAL 1 MONTH AS DATE), FALSE) AS INTEGER) AS will_fail_within_1m,
  CAST(date_m >= DATE '1998-03-01' AS INTEGER) AS regime, coalesce(amount, 0) AS amount, failure_date,
  lag(coalesce(amount, 0)) OVER (PARTITION BY entity ORDER BY period) AS amount_lag1 FROM m)
SELECT entity, date_m, year_month, will_fail_within_1m, regime, amount, amount_lag1,
  CASE WHEN date_m <= DATE '1999-12-31' THEN 'train' ELSE 'test' END AS split FROM l WHERE NOT coalesce(date_m >= failure_date, FALSE)""",
)
def model_ready_rows(spark, d):
    """Ordered projection of ids, label, regime, features and lags."""
    return model_ready(spark, d)


def model_ready(spark, d):
    from tessella.functions.numeric import regime_flag

    p = customer_panel(spark, d, lagged=("amount",)).withColumn("date_m", F.last_day(D))
    lagged = p.withColumns({
        "amount": F.coalesce("amount", F.lit(0.0)),
        "amount_lag1": F.when(F.col(D) > F.col("panel_start"), F.coalesce("amount_before", F.lit(0.0))),
    })
    labelled = LB.early_warning_labels(lagged, "date_m", horizons=(1,))
    rows = LB.drop_post_event(labelled).withColumn("regime", regime_flag(F.col("date_m"), "1998-03-01"))
    tagged = LB.split_tag(rows, "date_m", "1999-12-31")
    return tagged.select(
        E, "date_m", F.date_format("date_m", "yyyy-MM").alias("year_month"), "will_fail_within_1m", "regime", "amount",
        "amount_lag1", "split",
    )


@query(
    "time_split_counts",
    f"""WITH {SUPPLIER_MONTHS} SELECT CASE WHEN period <= DATE '1999-12-01' THEN 'train' ELSE 'test' END AS split, count(*) AS n,
  min(period) AS first_period, max(period) AS last_period FROM supplier_months GROUP BY 1""",
)
def time_split_counts(spark, d):
    """Two pushed filters, recombined."""
    train, test = LB.time_split(supplier_months(spark, d), D, "1999-12-01")
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return both.groupBy("split").agg(F.count("*").alias("n"), F.min(D).alias("first_period"), F.max(D).alias("last_period"))


PERIODS = f"""{SUPPLIER_MONTHS}, months AS (SELECT last_day(period) AS month, row_number() OVER (ORDER BY period) - 1 AS idx,
  count(*) OVER () AS n FROM (SELECT DISTINCT period FROM supplier_months))"""


@query(
    "period_slices",
    f"""WITH {PERIODS} SELECT month, CAST((SELECT count(*) FROM (SELECT unnest([0, 1, 2, 3, 4]) AS i) WHERE floor(i * n / 5) <= idx) - 1 AS INTEGER) AS slice FROM months""",
)
def period_slices(spark, d):
    """F13."""
    return LB.period_slices(supplier_months(spark, d), D, 5)


@query(
    "expanding_folds",
    f"""WITH {PERIODS} SELECT CAST(a.idx - 59 + 1 AS INTEGER) AS fold, a.month AS train_end, b.month AS val_month
FROM months a JOIN months b ON b.idx = a.idx + 1 WHERE a.idx BETWEEN 59 AND 64""",
)
def expanding_folds(spark, d):
    """at least 60 train months, six folds."""
    return LB.expanding_folds(supplier_months(spark, d), D, 60, 6).withColumn("fold", F.col("fold").cast("int"))


@query(
    "rows_per_fold",
    f"""WITH {PERIODS}, folds AS (SELECT CAST(a.idx - 59 + 1 AS INTEGER) AS fold, a.month AS train_end, b.month AS val_month
FROM months a JOIN months b ON b.idx = a.idx + 1 WHERE a.idx BETWEEN 59 AND 64)
SELECT fold, CASE WHEN last_day(period) <= train_end THEN 'train' ELSE 'validate' END AS role, count(*) AS n, round(sum(price), 2) AS price
FROM supplier_months, folds WHERE last_day(period) <= train_end OR last_day(period) = val_month GROUP BY 1, 2""",
)
def rows_per_fold(spark, d):
    """rows assigned to folds."""
    m = supplier_months(spark, d)
    rows = LB.fold_rows(m, D, LB.expanding_folds(m, D, 60, 6))
    return rows.groupBy(F.col("fold").cast("int").alias("fold"), "role").agg(
        F.count("*").alias("n"), r(F.sum("price"), 2).alias("price")
    )


@query(
    "exact_percentiles",
    """SELECT 'l_extendedprice' AS column_name, unnest([0.01, 0.25, 0.5, 0.99]::DOUBLE[]) AS prob,
  round(unnest(quantile_cont(l_extendedprice, [0.01, 0.25, 0.5, 0.99])), 6) AS value FROM lineitem
UNION ALL SELECT 'l_quantity', unnest([0.01, 0.25, 0.5, 0.99]::DOUBLE[]), round(unnest(quantile_cont(l_quantity, [0.01, 0.25, 0.5, 0.99])), 6) FROM lineitem""",
)
def exact_percentiles(spark, d):
    """Exact interpolated percentiles by running counts."""
    return rounded(percentiles(table(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"], [0.01, 0.25, 0.5, 0.99]))


TRAIN_CUT = "DATE '1999-12-01'"


@query(
    "median_imputed",
    f"""WITH {SUPPLIER_MONTHS}, t AS (SELECT quantile_cont(returned, 0.5) AS m FROM supplier_months WHERE period <= {TRAIN_CUT})
SELECT entity, period, round(coalesce(returned, m), 6) AS returned, 0.0::DOUBLE AS nothing FROM supplier_months, t""",
)
def median_imputed(spark, d):
    """K1: medians of the train part; an all-null column becomes 0."""
    m = supplier_months(spark, d).withColumn("nothing", F.lit(None).cast("double"))
    train, _ = LB.time_split(m, D, "1999-12-01")
    cols = ["returned", "nothing"]
    return rounded(FE.apply_impute(m, FE.fit_impute(train, cols), cols).select(E, D, *cols))


@query(
    "scaled_measures",
    f"""WITH {SUPPLIER_MONTHS}, s AS (SELECT avg(price) AS m, stddev_pop(price) AS s FROM supplier_months WHERE period <= {TRAIN_CUT})
SELECT entity, period, round((price - m) / s, 6) AS price, 0.0::DOUBLE AS constant FROM supplier_months, s""",
)
def scaled_measures(spark, d):
    """K2."""
    m = supplier_months(spark, d).withColumn("constant", F.lit(5.0))
    train, _ = LB.time_split(m, D, "1999-12-01")
    cols = ["price", "constant"]
    return rounded(FE.apply_scale(m, FE.fit_scale(train, cols), cols).select(E, D, *cols))


@query(
    "preprocessed_test_rows",
    f"""WITH {SUPPLIER_MONTHS}, med AS (SELECT quantile_cont(returned, 0.5) AS r, quantile_cont(quantity, 0.5) AS q FROM supplier_months WHERE period <= {TRAIN_CUT}),
f AS (SELECT entity, period, ln(1 + coalesce(returned, r)) AS returned, coalesce(quantity, q) AS quantity FROM supplier_months, med),
s AS (SELECT avg(returned) AS mr, stddev_pop(returned) AS sr, avg(quantity) AS mq, stddev_pop(quantity) AS sq FROM f WHERE period <= {TRAIN_CUT})
SELECT entity, period, round((returned - mr) / sr, 6) AS returned, round((quantity - mq) / sq, 6) AS quantity FROM f, s WHERE period > {TRAIN_CUT}""",
)
def preprocessed_test_rows(spark, d):
    """K3: impute, log1p the amount columns, scale; fitted on train."""
    m = supplier_months(spark, d).select(E, D, "returned", "quantity")
    train, test = LB.time_split(m, D, "1999-12-01")
    (out,) = FE.preprocess(train, [test], ["returned", "quantity"], ["returned"])
    return rounded(out)


@query(
    "winsorized_measures",
    f"""WITH {SUPPLIER_MONTHS}, b AS (SELECT quantile_cont(price, 0.01) AS lo, quantile_cont(price, 0.99) AS hi,
  quantile_cont(returned, 0.01) AS rlo, quantile_cont(returned, 0.99) AS rhi FROM supplier_months)
SELECT entity, period, round(greatest(least(price, hi), lo), 6) AS price, price < lo OR price > hi AS price_clipped,
  round(CASE WHEN returned IS NOT NULL THEN greatest(least(returned, rhi), rlo) END, 6) AS returned,
  coalesce(returned < rlo OR returned > rhi, FALSE) AS returned_clipped FROM supplier_months, b""",
)
def winsorized_measures(spark, d):
    """E11."""
    m = supplier_months(spark, d).select(E, D, "price", "returned")
    return rounded(FE.winsorize(m, ["price", "returned"]))


@query(
    "class_weighted_rows",
    f"""WITH {SCORED}, s AS (SELECT count(*) AS n, sum(toxic) AS pos FROM scored)
SELECT doc_id, round(n / (2.0 * CASE WHEN toxic = 1 THEN pos ELSE n - pos END), 6) AS weight FROM scored, s""",
)
def class_weighted_rows(spark, d):
    """K4."""
    return rounded(FE.class_weights(scored_documents(spark, d), "toxic").select("doc_id", "weight"))


@query(
    "negatives_downsampled",
    f"""WITH {SCORED} SELECT toxic, CASE WHEN toxic = 1 THEN count(*) ELSE least(count(*), 3 * (SELECT count(*) FROM scored WHERE toxic = 1)) END AS n
FROM scored GROUP BY 1""",
)
def negatives_downsampled(spark, d):
    """K5: exact sample size, reproducible choice."""
    kept = FE.downsample_negatives(scored_documents(spark, d), "toxic", ["doc_id"], 3, 42)
    return kept.groupBy("toxic").agg(F.count_distinct("doc_id").alias("n"))
