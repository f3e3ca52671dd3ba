"""Classifiers on panels: fits, selection over time folds, calibration."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.numeric import clip
from tessella.operators.features import (
    apply_impute,
    apply_scale,
    class_weights,
    downsample_negatives,
    fit_impute,
    fit_scale,
)
from tessella.operators.labels import block_fold_rows, period_slices
from tessella.operators.many_fits import Fit, fit_many, prepared_groups, score_many
from tessella.operators.metrics import ranking_metrics
from tessella.operators.series import quoted
from tessella.session import freeze, materialize


@dataclass
class Fitted:
    """A fitted classifier with the columns it was fitted on."""

    model: Model
    features: list[str]

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        if isinstance(self.model, LogisticRegressionModel):
            # A plain expression: no vector, and the model object (whose
            # training summary holds the session) never goes to the tasks.
            margin = F.lit(float(self.model.intercept))
            for c, b in zip(self.features, self.model.coefficients):
                margin = margin + quoted(c) * float(b)
            return df.withColumn(out, 1 / (1 + F.exp(-margin)))
        scored = self.model.transform(assemble(df, self.features))
        return scored.withColumn(out, vector_to_array("probability")[1]).drop(
            "features", "rawPrediction", "probability", "prediction"
        )


def save_linear(fitted: Fitted, stats: DataFrame, medians: DataFrame, calibrator: Fitted | None, path: str) -> None:
    """Write a logistic fit as tables: coefficients, scaling, medians, calibrator.

    ``stats`` has (feature, mean, deviation), ``medians`` (feature, median).
    """
    spark = stats.sparkSession
    rows = [("intercept", float(fitted.model.intercept)), *zip(fitted.features, map(float, fitted.model.coefficients))]
    if calibrator is not None:
        rows += [("calibration_intercept", float(calibrator.model.intercept)), ("calibration_slope", float(calibrator.model.coefficients[0]))]
    spark.createDataFrame(rows, "term string, coef double").coalesce(1).write.parquet(f"{path}/coefficients")
    stats.join(medians, "feature").coalesce(1).write.parquet(f"{path}/features")


def score_saved(df: DataFrame, path: str, out: str = "p") -> DataFrame:
    """Score new rows from ``save_linear`` tables: impute, scale, add up, calibrate.

    The tables have one row per feature and are read to the driver.
    """
    spark = df.sparkSession
    coef = {r["term"]: r["coef"] for r in spark.read.parquet(f"{path}/coefficients").collect()}
    margin = F.lit(coef["intercept"])
    for r in spark.read.parquet(f"{path}/features").orderBy("feature").collect():
        value = F.coalesce(quoted(r["feature"]).cast("double"), F.lit(r["median"]), F.lit(0.0))
        scale = r["deviation"] if r["deviation"] and r["deviation"] > 0 else 1.0
        margin = margin + (value - F.lit(r["mean"])) / F.lit(scale) * F.lit(coef[r["feature"]])
    p = 1 / (1 + F.exp(-margin))
    if "calibration_slope" in coef:
        p = 1 / (1 + F.exp(-(p * coef["calibration_slope"] + coef["calibration_intercept"])))
    return df.withColumn(out, p)


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def fit_logistic(
    df: DataFrame, features: list[str], label: str, c: float = 1.0, l1: bool = False, balanced: bool = True
) -> Fitted:
    """Logistic regression with the penalty 1 / (C * total weight)."""
    weighted = class_weights(df, label) if balanced else df.withColumn("weight", F.lit(1.0))
    data = assemble(weighted, features).select("features", "weight", F.col(label).cast("double").alias("label"))
    data = data.persist()
    try:
        total = data.agg(F.sum("weight")).first()[0]
        for limit in (100, 1000, 10_000):
            model = LogisticRegression(
                elasticNetParam=1.0 if l1 else 0.0,
                regParam=1.0 / (c * total),
                standardization=False,
                weightCol="weight",
                maxIter=limit,
            ).fit(data)
            if model.summary.totalIterations < limit:
                break
        else:
            raise ArithmeticError(f"logistic regression did not converge in {limit} iterations")
    finally:
        data.unpersist()
    return Fitted(model, features)


def fit_gbt(
    df: DataFrame, features: list[str], label: str, depth: int = 4, step: float = 0.1, rounds: int = 20,
    min_leaf: int = 20, balanced: bool = True, seed: int = 42,
) -> Fitted:
    """Gradient-boosted trees with balanced weights."""
    weighted = class_weights(df, label) if balanced else df.withColumn("weight", F.lit(1.0))
    data = assemble(weighted, features).select("features", "weight", F.col(label).cast("double").alias("label"))
    model = GBTClassifier(
        weightCol="weight", maxDepth=depth, stepSize=step, maxIter=rounds,
        minInstancesPerNode=min_leaf, seed=seed,
    ).fit(data)
    return Fitted(model, features)


def prepare(train: DataFrame, frames: list[DataFrame], features: list[str], with_mean: bool = True) -> list[DataFrame]:
    """Impute and scale with statistics of ``train`` only."""
    medians = freeze(train, fit_impute(train, features))
    stats = freeze(train, fit_scale(apply_impute(train, medians, features), features))
    return [apply_scale(apply_impute(f, medians, features), stats, features, with_mean) for f in frames]


def coefficients(fitted: Fitted) -> DataFrame:
    """(feature, coef, abs_coef, rank): one row per feature."""
    spark = SparkSession.active()
    pairs = zip(fitted.features, (float(v) for v in fitted.model.coefficients))
    ranked = sorted(pairs, key=lambda p: (-abs(p[1]), p[0]))
    rows = [(f, c, abs(c), i + 1) for i, (f, c) in enumerate(ranked)]
    return spark.createDataFrame(rows, "feature string, coef double, abs_coef double, rank int")


def _at_once(work: Callable, items: list, threads: int = 4) -> list:
    """Results in order; a few independent fits share the cluster at a time."""
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(work, items))


def cv_select(
    folds: DataFrame, features: list[str], label: str, cs: list[float], metric: str = "average_precision",
    l1: bool = False,
) -> DataFrame:
    """Metric per (C, fold) on rows tagged by ``labels.fold_rows``; best first.

    Folds and grid are short lists; every fit runs on all its train rows, and all
    of them are fitted together.
    """
    tagged = folds.filter(F.col("role").isin("train", "validate"))
    ready = prepared_groups(tagged, "fold", features, label, train=F.col("role") == "train")
    numbers = [r["fold"] for r in ready.select("fold").distinct().orderBy("fold").collect()]
    every = tuple(range(len(features)))
    fits = fit_many(ready, "fold", [Fit(n, float(c), l1, every) for n in numbers for c in cs])
    # One pass scores and ranks every (C, fold) together.
    scored = score_many(ready.filter("not is_train"), "fold", fits).select("c", "fold", "label", "p")
    per_fold = materialize(ranking_metrics(scored, "label", "p", ["c", "fold"], listed_groups=True), "cv")
    return per_fold.groupBy("c").agg(
        F.avg(metric).alias("mean_metric"), F.count(metric).alias("folds")
    ).orderBy(F.desc_nulls_last("mean_metric"), "c")


def stability_select(
    df: DataFrame, period: str, features: list[str], label: str, n: int = 5, share: float = 0.6
) -> DataFrame:
    """L1 fit per time slice; features non-zero in enough valid slices.

    Slices under three periods or with one class are skipped; if no feature
    qualifies all are kept.  Ranked by frequency, then name.
    """
    spark = df.sparkSession
    slices = period_slices(df, period, n)
    sliced = df.withColumn("month", F.last_day(period)).join(F.broadcast(slices), "month")  # one row per month
    sliced = materialize(sliced.select("slice", "month", label, *features), "slices")
    info = (
        sliced.groupBy("slice")
        .agg(F.count_distinct("month").alias("months"), F.count_distinct(label).alias("classes"))
        .orderBy("slice")
        .collect()
    )
    valid = [r["slice"] for r in info if r["months"] >= 3 and r["classes"] >= 2]
    rows = []
    if valid:
        ready = prepared_groups(sliced.filter(F.col("slice").isin(valid)), "slice", features, label, with_mean=False)
        every = tuple(range(len(features)))
        for fit in fit_many(ready, "slice", [Fit(s, 1.0, True, every) for s in valid]):
            rows += [(f, int(abs(float(b)) > 1e-6)) for f, b in zip(features, fit.coef)]
    base = spark.createDataFrame([(f, 0) for f in features] + rows, "feature string, hit int")
    counted = base.groupBy("feature").agg(F.sum("hit").alias("slices_selected"))
    out = counted.withColumn("frequency", F.col("slices_selected") / F.lit(max(1, len(valid)))).withColumn(
        "enough", F.col("frequency") >= share
    )
    any_kept = out.agg(F.max("enough").alias("k")).scalar()
    return out.withColumn("selected", F.when(any_kept, F.col("enough")).otherwise(F.lit(True))).drop("enough")


def platt(oof: DataFrame, label: str, score: str) -> Fitted:
    """Logistic calibrator on out-of-fold scores."""
    return fit_logistic(oof, [score], label, c=1e6, balanced=False)


def out_of_fold_scores(train: DataFrame, features: list[str], label: str, n: int = 3) -> DataFrame:
    """Raw scores of train rows by fits that did not see them.

    Rows are dealt to ``n`` folds by a hash of their features, so equal rows are
    held out together.  Rows of one entity fall into several folds; see
    ``later_scores`` for a split by time.
    """
    dealt = train.withColumn("_part", F.pmod(F.xxhash64(*features), F.lit(n)))

    def held_out(k: int) -> DataFrame:
        fit = fit_logistic(dealt.filter(F.col("_part") != k), features, label)
        return fit.score(dealt.filter(F.col("_part") == k), "raw")

    return reduce(DataFrame.unionByName, [held_out(k) for k in range(n)]).drop("_part")


def later_scores(
    df: DataFrame, period: str, features: list[str], label: str, keys: list[str], first: int, n: int = 3
) -> DataFrame:
    """Raw scores of all rows after the first ``first`` months, each by a fit of
    earlier months only: ``keys``, fold, label and ``raw``.

    A calibrator on these sees scores as they will be when months are scored that
    no fit has seen.  All folds are fitted together.
    """
    folds = block_fold_rows(df, period, first, n)
    ready = prepared_groups(folds, "fold", features, label, train=F.col("role") == "train", keys=tuple(keys))
    every = tuple(range(len(features)))
    numbers = [r["fold"] for r in ready.select("fold").distinct().orderBy("fold").collect()]
    fits = fit_many(ready, "fold", [Fit(k, 1.0, False, every) for k in numbers])
    scored = score_many(ready.filter("not is_train"), "fold", fits, "raw")
    return scored.select(*keys, "fold", F.col("label").alias(label), "raw")


def _calibrators(train: DataFrame, numbers: list[int], every: tuple[int, ...], n: int = 3) -> tuple[list[Fit], list[Fit]]:
    """Per fold an L2 fit of its train rows and a Platt step on out-of-fold scores.

    Rows are dealt as in ``out_of_fold_scores``.  The fits of all folds, with all of
    their rows and without each part, are made together, and so are the Platt steps.
    """
    place = F.col("fold") * n + F.pmod(F.xxhash64("x"), F.lit(n)).cast("int")
    dealt = train.select("fold", "label", "x", F.lit(True).alias("is_train"), F.lit(1.0).alias("weight"), place.alias("place"))
    sizes = dealt.groupBy("place").agg(F.count("label").alias("n"), F.sum(F.col("label").cast("long")).alias("pos")).collect()
    counts = {r["place"]: (r["n"] - r["pos"], r["pos"]) for r in sizes}

    def on(group: int, places: list[int]) -> Fit:
        by_class = [sum(counts[p][k] for p in places if p in counts) for k in (0, 1)]
        balanced = tuple(sum(by_class) / (2 * c) if c else 0.0 for c in by_class)
        return Fit(group, 1.0, False, every, sees=tuple(places), classes=balanced)

    own = {f: [f * n + k for k in range(n)] for f in numbers}
    whole = [on(f, own[f]) for f in numbers]
    without = [on(p, [q for q in own[f] if q != p]) for f in numbers for p in own[f]]
    fit_many(dealt, "place", whole + without)
    scores = score_many(dealt, "place", without, "raw").select(
        "fold", "label", "is_train", F.lit(1.0).alias("weight"), F.array("raw").alias("x")
    )
    return whole, fit_many(materialize(scores, "raw-scores"), "fold", [Fit(f, 1e6, False, (0,)) for f in numbers])


def out_of_fold(
    folds: DataFrame, features: list[str], label: str, keys: list[str], neg_ratio: int = 20, seed: int = 42
) -> DataFrame:
    """Predictions of every validation fold by models of its own train rows: the
    mean of a calibrated L2 logistic fit and of boosted trees.

    Folds without both classes in train are skipped; negatives are sampled
    reproducibly; imputation and scaling are fitted inside the fold.  All folds
    are sampled, prepared, fitted linearly and scored in the same passes; only the
    trees are grown fold by fold, on the sampled rows.
    """
    info = (
        folds.groupBy("fold")
        .agg(
            F.count_distinct(F.when(F.col("role") == "train", F.col(label))).alias("classes"),
            F.count(F.when(F.col("role") == "validate", 1)).alias("n_valid"),
        )
        .orderBy("fold")
        .collect()
    )
    numbers = [r["fold"] for r in info if r["classes"] == 2 and r["n_valid"]]
    used = folds.filter(F.col("fold").isin(numbers))
    sample = downsample_negatives(used.filter("role = 'train'"), label, keys, neg_ratio, seed, ["fold"])
    rows = sample.unionByName(used.filter("role = 'validate'"))
    ready = prepared_groups(rows, "fold", features, label, train=F.col("role") == "train", keys=tuple(keys))
    # Written once for all folds: fits and tree rounds read the sample many times.
    train = materialize(ready.filter("is_train").select("fold", "label", "x"), "fold-train")
    linear, steps = _calibrators(train, numbers, tuple(range(len(features))))
    named = [F.col("x")[j].alias(f) for j, f in enumerate(features)]

    def grown(fold: int) -> Fitted:
        own = train.filter(F.col("fold") == fold).select("label", *named)
        return fit_gbt(own, features, "label", rounds=10, balanced=False)

    trees = _at_once(grown, numbers)
    known = train.sparkSession.createDataFrame(
        [(f.group, f.intercept, float(f.coef[0])) for f in steps], "fold int, _level double, _slope double"
    )
    scored = score_many(ready.filter("not is_train"), "fold", linear, "raw").join(F.broadcast(known), "fold")  # one row per fold
    scored = scored.withColumn("p_linear", 1 / (1 + F.exp(-(F.col("_level") + F.col("raw") * F.col("_slope")))))
    kept = [*[F.col(k) for k in keys], "fold", F.col("label").alias("y"), "p_linear"]

    def blended(fold: int, model: Fitted) -> DataFrame:
        both = model.score(scored.filter(F.col("fold") == fold).select(*kept, *named), "p_trees")
        return both.select(*keys, "fold", "y", ((F.col("p_linear") + F.col("p_trees")) / 2).alias("p"))

    return materialize(reduce(DataFrame.unionByName, map(blended, numbers, trees)), "out-of-fold")


def sweep_top_k(
    train: DataFrame, test: DataFrame, ranked: list[str], label: str, ks: list[int]
) -> DataFrame:
    """Refits on the k most important features for several k, all together."""
    def tagged(df: DataFrame, is_train: bool) -> DataFrame:
        return class_weights(df, label).select(
            F.lit(0).alias("all"), F.col(label).alias("label"), F.lit(is_train).alias("is_train"), "weight",
            F.array(*[quoted(f).cast("double") for f in ranked]).alias("x"),
        )

    both = materialize(tagged(train, True).unionByName(tagged(test, False)), "sweep")
    fits = fit_many(both, "all", [Fit(0, 1.0, True, tuple(range(min(k, len(ranked))))) for k in ks])
    scored = score_many(both.filter("not is_train"), "all", fits)
    names = F.create_map(*[x for i, k in enumerate(ks) for x in (F.lit(i), F.lit(k))])
    scored = scored.select(names[F.col("fit")].alias("k"), "label", "p")
    metrics = ranking_metrics(scored, "label", "p", ["k"], listed_groups=True)
    return metrics.select("k", "roc_auc", "average_precision")


def score_at(
    df: DataFrame, coefs: DataFrame, stats, entity: str, period: str, base: list[str], lags: list[int],
    date: str | None = None, entities: DataFrame | None = None,
) -> DataFrame:
    """Score one date (default: the latest) with lagged, scaled features and a
    per-entity coefficient table; entities without a model are skipped."""
    from tessella.operators.econometrics import lookup_score
    from tessella.operators.features import add_lags

    cols = [f"{c}_lag{k}" for c in base for k in lags]
    lagged = add_lags(df.select(entity, period, *base), entity, period, base, lags).na.drop(subset=cols)
    if entities is not None:
        lagged = lagged.join(entities, entity, "left_semi")
    day = F.lit(date).cast("date") if date else lagged.agg(F.max(period).alias("d")).scalar()
    ready = apply_scale(lagged.filter(F.col(period) == day), stats, cols)
    scored = lookup_score(ready, coefs, entity, cols, "pred")
    return scored.select(entity, period, clip(F.col("pred"), 0.0, 1.0).alias("prob_fail"))
