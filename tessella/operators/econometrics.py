"""Panel regression, per-entity regressions and residual dynamics.

Fits work on sufficient statistics: Spark sums cross-products with map-side
combine, and only k x k matrices (k = number of regressors) are solved.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.features import month_window
from tessella.operators.series import quoted
from tessella.session import materialize


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _square(values: list[float], k: int) -> np.ndarray:
    out = np.zeros((k, k))
    for (i, j), v in zip(_pairs(k), values):
        out[i, j] = out[j, i] = v if v is not None else 0.0
    return out


def gram(df: DataFrame, cols: list[Column]) -> tuple[int, np.ndarray]:
    """Row count and cross-product matrix of a few columns, in one pass."""
    sums = [F.sum(cols[i] * cols[j]) for i, j in _pairs(len(cols))]
    row = df.agg(F.count("*").alias("n"), F.array(*sums).alias("g")).first()
    return row["n"], _square(row["g"], len(cols))


#: Period effects are solved for together; more periods than this are refused.
MAX_PERIODS = 4096


def _shared_periods(place: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(p, q, w): what patterns of periods add to each pair of periods, where a
    pattern of n periods that c entities have adds c / n to each of its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(place), len(place)))
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x = np.zeros((part.num_rows, len(place)))
                periods = part.column("ps")
                row = np.repeat(np.arange(part.num_rows), periods.value_lengths().to_numpy())
                x[row, [place[p] for p in periods.flatten().to_pylist()]] = 1
                total += x.T @ (x * (part.column("c").to_numpy() / x.sum(1))[:, None])
        p, q = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(q, pa.int32()), pa.array(total[p, q])], ["p", "q", "w"])

    return run


def two_way_demean(df: DataFrame, entity: str, period: str, cols: list[str], tol: float = 1e-8) -> DataFrame:
    """Remove entity and period effects from every column (``<col>_within``).

    The period effects b solve (N - sum_i 1/n_i e_i e_i') b = r, where N holds
    the rows per period, e_i marks the periods of entity i, n_i is their number
    and r sums each period's deviations from entity means.  Entities with the same
    periods are counted as one pattern, and a task adds up its patterns as a
    matrix product, so no pair of periods is made per entity.  The system is
    periods x periods whatever the number of entities and is solved directly by one
    factorization, also for panels that fall into unconnected parts.  Entity
    effects follow within each entity's rows.  A solution that misses ``tol``, more
    than MAX_PERIODS periods or nulls in ``cols`` are errors.

    Rows are unique per (entity, period).  They are written once and read from there.
    """
    spark = df.sparkSession
    df = materialize(df, "demean")
    value = [quoted(c).cast("double") for c in cols]
    k = len(cols)
    centre = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(value)]).first()
    value = [v - F.lit(float(centre[i] or 0.0)) for i, v in enumerate(value)]
    per_entity = df.groupBy(quoted(entity).alias("entity")).agg(
        F.array_sort(F.collect_list(period)).alias("ps"),  # at most one per period
        *[F.avg(v).alias(f"_a{i}") for i, v in enumerate(value)],
    )
    per_entity = materialize(per_entity.drop("entity"), "demean-entities")
    per_period = df.groupBy(quoted(period).alias("p")).agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(v) for v in value]).alias("s"),
        F.array(*[F.count(v) for v in value]).alias("filled"),
        F.array(*[F.max(F.abs(v)) for v in value]).alias("largest"),
    )
    rows = per_period.limit(MAX_PERIODS + 1).collect()
    if len(rows) > MAX_PERIODS:
        raise ValueError(f"more than {MAX_PERIODS} periods: truncate them first")
    if any(c != r["n"] for r in rows for c in r["filled"]):
        raise ValueError("columns to demean hold nulls")
    if not rows:
        return df.withColumns({f"{c}_within": F.lit(None).cast("double") for c in cols})
    place = {r["p"]: i for i, r in enumerate(rows)}
    own = per_entity.select(F.explode("ps").alias("p"), *[f"_a{i}" for i in range(k)])
    means = own.groupBy("p").agg(F.array(*[F.sum(f"_a{i}") for i in range(k)]).alias("s")).collect()
    patterns = per_entity.groupBy("ps").agg(F.count("*").alias("c"))
    pairs = patterns.mapInArrow(_shared_periods(place), "p int, q int, w double")
    matrix = np.diag([float(r["n"]) for r in rows])
    for r in pairs.groupBy("p", "q").agg(F.sum("w").alias("w")).collect():
        matrix[r["p"], r["q"]] -= r["w"]
    right = np.array([r["s"] for r in rows], float)
    for r in means:
        right[place[r["p"]]] -= r["s"]
    size, axes = np.linalg.eigh(matrix)
    held = np.abs(size) > 1e-12 * np.abs(size).max(initial=0)
    axes, size = axes[:, held], size[held]

    def solved(side: np.ndarray) -> np.ndarray:
        return axes @ ((axes.T @ side) / size[:, None])

    effects = solved(right)
    for _ in range(2):  # iterative refinement of the last digits
        effects += solved(right - matrix @ effects)
    missed = np.abs(right - matrix @ effects).max(axis=0)
    rounding = 1e-15 * np.array([r["largest"] for r in rows], float).max(axis=0) * max(r["n"] for r in rows)
    if (missed > tol * np.maximum(1.0, np.abs(right).max(axis=0)) + rounding).any():
        raise ArithmeticError(f"period effects miss the normal equations by {missed.max()}")
    schema = T.StructType(
        [T.StructField(period, df.schema[period].dataType), T.StructField("_b", T.ArrayType(T.DoubleType()))]
    )
    table = spark.createDataFrame([(r["p"], [float(x) for x in effects[i]]) for i, r in enumerate(rows)], schema)
    shifted = df.join(F.broadcast(table), period)  # at most MAX_PERIODS rows
    w = Window.partitionBy(entity)
    less = [v - F.col("_b")[i] for i, v in enumerate(value)]
    return shifted.withColumns({f"{c}_within": x - F.avg(x).over(w) for c, x in zip(cols, less)}).drop("_b")


def _beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    total = d
    for m in range(1, 100_000):
        up = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / (1 + up * d or 1e-300), 1 + up / c or 1e-300
        total *= d * c
        down = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / (1 + down * d or 1e-300), 1 + down / c or 1e-300
        total *= d * c
        if abs(d * c - 1) < 1e-14:
            return front * total
    raise ArithmeticError("incomplete beta function did not settle")


def t_tail(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t."""
    return _beta_tail(dof / (dof + t * t), dof / 2, 0.5)


def f_tail(f: float, k: float, dof: float) -> float:
    """p-value of an F statistic."""
    return _beta_tail(dof / (dof + k * f), dof / 2, k / 2)


def panel_ols(
    df: DataFrame, y: str, xs: list[str], entity: str, period: str, min_rows: int = 100, model: str = "model"
) -> DataFrame:
    """Two-way fixed-effects regression with entity-clustered errors.

    One row per kept regressor: coefficient, standard error, t, p (Student's t)
    and the model's R2 values, F and its p, rows and entities.  Between and total
    R2 are 1 - SSR/TSS of the fitted slopes on entity means and raw rows; the model
    has no intercept, so TSS is not centred and R2 may be negative.  Columns
    absorbed by the effects are dropped; too few rows give no result.
    """
    spark = df.sparkSession
    schema = (
        "model string, term string, coef double, std_err double, t_stat double, p_value double, "
        "r2_within double, r2_between double, r2_total double, f_stat double, f_p_value double, nobs long, entities long"
    )
    data = df.select(entity, period, *[quoted(c).cast("double").alias(c) for c in [y, *xs]]).na.drop()
    # Read many times below: written once instead of recomputing the input.
    data = materialize(data, "panel-ols")
    rows, raw = gram(data, [quoted(c) for c in [y, *xs]])
    if rows <= min_rows:
        return spark.createDataFrame([], schema)
    demeaned = two_way_demean(data, entity, period, [y, *xs])
    demeaned = demeaned.persist()
    try:
        n, g = gram(demeaned, [quoted(f"{c}_within") for c in [y, *xs]])
        kept: list[int] = []
        for i in range(1, len(xs) + 1):
            idx = [*kept, i]
            if g[i, i] <= 1e-10 * max(raw[i, i], 1e-300):
                continue  # absorbed by the effects
            sub = g[np.ix_(idx, idx)]
            scale = np.sqrt(np.outer(np.diag(sub), np.diag(sub)))
            if np.linalg.cond(sub / scale) < 1e12:
                kept.append(i)
        if not kept:
            return spark.createDataFrame([], schema)
        names = [xs[i - 1] for i in kept]
        bread = np.linalg.inv(g[np.ix_(kept, kept)])
        beta = bread @ g[kept, 0]
        fitted = sum(
            (quoted(f"{c}_within") * float(b) for c, b in zip(names, beta)), F.lit(0.0)
        )
        resid = quoted(f"{y}_within") - fitted
        scores = demeaned.groupBy(entity).agg(
            *[F.sum(quoted(f"{c}_within") * resid).alias(f"_s{i}") for i, c in enumerate(names)]
        )
        k = len(names)
        entities, meat = gram(scores, [F.col(f"_s{i}") for i in range(k)])
        months = data.select(period).distinct().count()
        dof = max(n - k - entities - months + 1, 1)
        adjust = (entities / max(entities - 1, 1)) * ((n - 1) / max(n - k, 1))
        cov = bread @ meat @ bread * adjust
        se = np.sqrt(np.clip(np.diag(cov), 0, None))
        rss = float(g[0, 0] - beta @ g[kept, 0])
        tss = float(g[0, 0])
        r2_within = 1 - rss / tss if tss > 0 else None
        f_stat = ((tss - rss) / k) / (rss / dof) if rss > 0 else None

        f_p = f_tail(f_stat, k, dof) if f_stat is not None else None

        def r2_raw(frame: DataFrame) -> float | None:
            pred = sum((quoted(c) * float(b) for c, b in zip(names, beta)), F.lit(0.0))
            gap = quoted(y) - pred
            r = frame.agg(F.sum(gap * gap).alias("rss"), F.sum(quoted(y) * quoted(y)).alias("tss")).first()
            return 1 - r["rss"] / r["tss"] if r["tss"] else None

        means = data.groupBy(entity).agg(*[F.avg(quoted(c)).alias(c) for c in [y, *names]])
        between, total = r2_raw(means), r2_raw(data)
    finally:
        demeaned.unpersist()
    rows = []
    for name, b, s in zip(names, beta, se):
        t = float(b / s) if s > 0 else None
        p = t_tail(t, dof) if t is not None else None
        rows.append((model, name, float(b), float(s), t, p, r2_within, between, total, f_stat, f_p, n, entities))
    return spark.createDataFrame(rows, schema)


def panel_variants(
    df: DataFrame, y: str, entity: str, period: str, groups: dict[str, list[str]]
) -> DataFrame:
    """One regression per named variable list, stacked with significance marks."""
    spark_frames = [
        panel_ols(df, y, xs, entity, period, model=name) for name, xs in groups.items() if xs
    ]
    out = spark_frames[0]
    for f in spark_frames[1:]:
        out = out.unionByName(f)
    p = F.col("p_value")
    stars = F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise("")
    return out.withColumn("significance", stars)


def grouped_ols(
    df: DataFrame, entity: str, y: str, xs: list[str], min_rows: int = 12
) -> DataFrame:
    """Least squares without intercept per entity: (entity, coef array, n).

    Cross-products are summed per entity by Spark; batches of k x k systems
    are then solved with a pseudo-inverse (minimum-norm least squares).
    """
    k = len(xs)
    x = [F.coalesce(quoted(c).cast("double"), F.lit(0.0)) for c in xs]
    yy = F.coalesce(quoted(y).cast("double"), F.lit(0.0))
    stats = df.groupBy(entity).agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(x[i] * x[j]) for i, j in _pairs(k)]).alias("xx"),
        F.array(*[F.sum(x[i] * yy) for i in range(k)]).alias("xy"),
    ).filter(F.col("n") >= min_rows)
    entity_type = df.schema[entity].dataType.simpleString()

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row, col = np.triu_indices(k)
        for batch in batches:
            stack = np.zeros((len(batch), k, k))
            if len(batch):
                stack[:, row, col] = np.array(batch["xx"].tolist(), float)
                stack[:, col, row] = stack[:, row, col]
            right = np.array(batch["xy"].tolist(), float).reshape(-1, k)
            coefs = np.einsum("nij,nj->ni", np.linalg.pinv(stack, hermitian=True), right).tolist()
            yield pd.DataFrame({entity: batch[entity], "coef": coefs, "n": batch["n"]})

    return stats.mapInPandas(solve, f"`{entity}` {entity_type}, coef array<double>, n long")


def score_grouped(df: DataFrame, coefs: DataFrame, entity: str, xs: list[str], out: str) -> DataFrame:
    """Dot product with the entity's coefficients; entities without a fit score 0."""
    joined = df.join(coefs.select(entity, "coef"), entity, "left")
    terms = [F.coalesce(quoted(c).cast("double"), F.lit(0.0)) * F.col("coef")[i] for i, c in enumerate(xs)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return joined.withColumn(out, F.coalesce(total, F.lit(0.0))).drop("coef")


def lookup_score(df: DataFrame, coefs: DataFrame, entity: str, xs: list[str], out: str) -> DataFrame:
    """As ``score_grouped`` but entities without a model are skipped."""
    return score_grouped(df.join(coefs.select(entity), entity, "left_semi"), coefs, entity, xs, out)


def residual_ar(
    df: DataFrame, entity: str, period: str, label: str, score: str, split: str, min_rows: int = 8
) -> DataFrame:
    """Correct scores by an AR(1) on each entity's train residuals.

    phi = sum(r_t r_{t-1}) / sum(r_{t-1}^2); train rows get the one-step fit,
    the h-th test row gets phi^h times the last train residual.  r_{t-1} is the
    residual of the month before, null where that month has no row.  Entities
    with fewer than ``min_rows`` train rows stay uncorrected.
    """
    train = F.col(split) == "train"
    ordered = month_window(df, entity, period)
    whole = Window.partitionBy(entity)
    r = F.when(train, F.col(label) - F.col(score))
    step = df.withColumn("_r", r).withColumn("_lag", F.first("_r").over(ordered.rangeBetween(-1, -1)))
    phi = F.try_divide(
        F.sum(F.when(train, F.col("_r") * F.col("_lag"))).over(whole),
        F.sum(F.when(train, F.col("_lag") * F.col("_lag"))).over(whole),
    )
    fitted = (
        step.withColumn("_phi", phi)
        .withColumn("_n", F.count(F.when(train, 1)).over(whole))
        .withColumn("_last", F.last("_r", ignorenulls=True).over(ordered))
        .withColumn(
            "_h",
            F.count(F.when(~train, 1)).over(ordered.rowsBetween(Window.unboundedPreceding, 0)),
        )
    )
    ahead = F.when(train, F.col("_phi") * F.col("_lag")).otherwise(
        F.pow("_phi", F.col("_h")) * F.col("_last")
    )
    resid = F.when(F.col("_n") >= min_rows, F.coalesce(ahead, F.lit(0.0))).otherwise(F.lit(0.0))
    adjusted = F.greatest(F.least(F.col(score) + resid, F.lit(1.0)), F.lit(0.0))
    return fitted.withColumn("residual_forecast", resid).withColumn("adjusted", adjusted).drop(
        "_r", "_lag", "_phi", "_n", "_last", "_h"
    )


def logit_wald(df: DataFrame, features: list[str], coefs: list[float], intercept: float) -> DataFrame:
    """Wald table of a fitted logit: error, z, p, 95 % interval per feature.

    The Hessian sum p (1 - p) x x' is one aggregation.
    """
    z = F.lit(float(intercept))
    for c, b in zip(features, coefs):
        z = z + quoted(c) * float(b)
    p = 1 / (1 + F.exp(-z))
    root = F.sqrt(p * (1 - p))
    _, hessian = gram(df, [root, *[quoted(c) * root for c in features]])
    cov = np.linalg.pinv(hessian, hermitian=True)
    rows = []
    for i, (name, b) in enumerate(zip(["intercept", *features], [intercept, *coefs])):
        se = math.sqrt(max(float(cov[i, i]), 0.0))
        stat = float(b) / se if se > 0 else None
        pv = math.erfc(abs(stat) / math.sqrt(2)) if stat is not None else None
        rows.append(
            (name, float(b), se, stat, pv, float(b) - 1.96 * se, float(b) + 1.96 * se,
             pv is not None and pv < 0.05)
        )
    return df.sparkSession.createDataFrame(
        rows,
        "term string, coef double, std_err double, z double, p_value double, ci_low double, "
        "ci_high double, significant boolean",
    )
