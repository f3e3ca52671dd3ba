"""Exact ranking, threshold and calibration metrics for rare-event scores.

Everything starts from counts per distinct score (partial sums before the
shuffle) with running totals from ``ordered_totals``; no task sorts all scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.quantiles import ordered_totals
from tessella.operators.series import quoted


def score_table(
    df: DataFrame, label: str, score: str, groups: list[str] | None = None, listed_groups: bool = False
) -> DataFrame:
    """Per distinct score: tp, fp, running TP/FP (score and above), totals.

    Rows without a score are refused: leaving them out would drop positives
    from recall and totals.  Score them, or filter them where that is meant.
    """
    groups = list(groups or [])
    y = F.col(label).cast("long")
    scored = F.when(F.col(score).isNull(), F.raise_error(F.lit(f"{score} is null"))).otherwise(F.col(score))
    counts = (
        df.withColumn("score", scored.cast(df.schema[score].dataType))
        .groupBy(*groups, "score")
        .agg(F.sum(y).alias("tp"), F.sum(1 - y).alias("fp"))
    )
    return ordered_totals(counts, "score", ["tp", "fp"], groups, listed_groups=listed_groups)


def pr_curve(table: DataFrame) -> DataFrame:
    """Precision and recall when alerting at each distinct score."""
    return table.withColumns(
        {
            "precision": F.col("run_tp") / (F.col("run_tp") + F.col("run_fp")),
            "recall": F.try_divide(F.col("run_tp"), F.col("all_tp")),
        }
    )


def _ranking_aggs():
    area = F.sum(F.col("fp") * (F.col("run_tp") - F.col("tp") + F.col("tp") / 2))
    both = F.max("all_tp") * F.max("all_fp").cast("double")
    gain = F.try_divide(F.col("tp"), F.col("all_tp"))
    return {
        "roc_auc": F.try_divide(area, both),
        "average_precision": F.sum(gain * F.col("run_tp") / (F.col("run_tp") + F.col("run_fp"))),
    }


def ranking_metrics(
    df: DataFrame, label: str, score: str, groups: list[str] | None = None, listed_groups: bool = False
) -> DataFrame:
    """ROC-AUC (null for one class) and average precision over thresholds."""
    table = score_table(df, label, score, groups, listed_groups)
    aggs = [
        F.max("all_tp").alias("positives"),
        F.max("all_fp").alias("negatives"),
        *[e.alias(n) for n, e in _ranking_aggs().items()],
    ]
    return table.groupBy(*groups).agg(*aggs) if groups else table.agg(*aggs)


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    return ranking_metrics(df, label, score).select("roc_auc")


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    return ranking_metrics(df, label, score).select("average_precision")


def brier(df: DataFrame, label: str, score: str, groups: list[str] | None = None) -> DataFrame:
    gap = F.col(score) - F.col(label)
    agg = F.avg(gap * gap).alias("brier")
    return df.groupBy(*groups).agg(agg) if groups else df.agg(agg)


def quality_metrics(df: DataFrame, label: str, score: str, groups: list[str]) -> DataFrame:
    """AUC, average precision and Brier score per short-list group."""
    return ranking_metrics(df, label, score, groups).join(brier(df, label, score, groups), groups)


def confusion(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    return df.agg(
        F.count(F.when(hit & pos, 1)).alias("tp"),
        F.count(F.when(hit & ~pos, 1)).alias("fp"),
        F.count(F.when(~hit & pos, 1)).alias("fn"),
        F.count(F.when(~hit & ~pos, 1)).alias("tn"),
    ).withColumns(
        {
            "precision": F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)),
            "recall": F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0)),
        }
    )


def _threshold_points(table: DataFrame) -> DataFrame:
    """Precision and recall at 0, every score and 1.

    Zero alerts on every row and so repeats the lowest score's counts; one
    repeats the score 1.0 or alerts on nothing.
    """
    at_scores = table.select(
        F.col("score").alias("threshold"), "run_tp", "run_fp", "all_tp", "all_fp"
    )
    ends = table.groupBy().agg(
        F.max("all_tp").alias("all_tp"),
        F.max("all_fp").alias("all_fp"),
        F.coalesce(F.max(F.when(F.col("score") >= 1.0, F.col("run_tp"))), F.lit(0)).alias("tp1"),
        F.coalesce(F.max(F.when(F.col("score") >= 1.0, F.col("run_fp"))), F.lit(0)).alias("fp1"),
        F.coalesce(F.max(F.when(F.col("score") >= 0.0, F.col("run_tp"))), F.lit(0)).alias("tp0"),
        F.coalesce(F.max(F.when(F.col("score") >= 0.0, F.col("run_fp"))), F.lit(0)).alias("fp0"),
    )
    zero = ends.select(
        F.lit(0.0).alias("threshold"), F.col("tp0").alias("run_tp"), F.col("fp0").alias("run_fp"),
        "all_tp", "all_fp",
    )
    one = ends.select(
        F.lit(1.0).alias("threshold"), F.col("tp1").alias("run_tp"), F.col("fp1").alias("run_fp"),
        "all_tp", "all_fp",
    )
    alerts = F.col("run_tp") + F.col("run_fp")
    return at_scores.unionByName(zero).unionByName(one).withColumns(
        {
            "precision": F.coalesce(F.try_divide(F.col("run_tp"), alerts), F.lit(0.0)),
            "recall": F.coalesce(F.try_divide(F.col("run_tp"), F.col("all_tp")), F.lit(0.0)),
        }
    )


def _with_confusion(best: DataFrame) -> DataFrame:
    return best.withColumns(
        {
            "tp": F.col("run_tp"),
            "fp": F.col("run_fp"),
            "fn": F.col("all_tp") - F.col("run_tp"),
            "tn": F.col("all_fp") - F.col("run_fp"),
        }
    ).drop("run_tp", "run_fp", "all_tp", "all_fp")


def threshold_precision_floor(df: DataFrame, label: str, score: str, floor: float) -> DataFrame:
    """Highest recall with precision at least ``floor`` (lowest threshold on
    ties); if no threshold reaches it, highest precision, then recall."""
    points = _threshold_points(score_table(df, label, score)).withColumn(
        "feasible", (F.col("precision") >= floor) & (F.col("recall") > 0)
    )
    aim = F.when(F.col("feasible"), F.col("recall")).otherwise(F.col("precision"))
    best = points.orderBy(
        F.desc("feasible"), aim.desc(), F.desc("recall"), F.asc("threshold")
    ).limit(1)
    return _with_confusion(best)


def threshold_fbeta(df: DataFrame, label: str, score: str, beta: float) -> DataFrame:
    """Threshold with the highest F-beta, the lowest one on ties."""
    b2 = beta * beta
    p, r = F.col("precision"), F.col("recall")
    f = F.coalesce(F.try_divide((1 + b2) * p * r, b2 * p + r), F.lit(0.0))
    points = _threshold_points(score_table(df, label, score)).withColumn("f_beta", f)
    return _with_confusion(points.orderBy(F.desc("f_beta"), F.asc("threshold")).limit(1))


def calibration(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Mean score and event rate in uniform bins; empty bins are absent."""
    slot = F.greatest(F.ceil(F.col(score) * bins).cast("int"), F.lit(1))
    return df.groupBy(slot.alias("bin")).agg(
        F.count("*").alias("n"),
        F.avg(score).alias("mean_predicted"),
        F.avg(label).alias("event_rate"),
    )


def univariate_auc(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Orientation-free AUC of every feature, all features in one pass."""
    long = df.select(F.col(label).alias("y"), *[quoted(c).cast("double").alias(c) for c in features]).unpivot(
        ["y"], [quoted(c) for c in features], "feature", "value"
    )
    auc = ranking_metrics(long, "y", "value", ["feature"], listed_groups=True).select("feature", "roc_auc")
    return auc.withColumn("power", F.greatest("roc_auc", 1 - F.col("roc_auc")))


def mutual_information(df: DataFrame, features: list[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of the label and each feature's uniform bins.

    Equal-width bins between the feature's minimum and maximum; only the
    counts per (feature, bin, label) are shuffled.
    """
    from tessella.session import bound, one_row

    stats = one_row(
        df,
        **{f"a{i}": F.min(quoted(c)).cast("double") for i, c in enumerate(features)},
        **{f"b{i}": F.max(quoted(c)).cast("double") for i, c in enumerate(features)},
    )

    def slot(i: int, c: str):
        lo, hi = F.col(f"_stats.a{i}"), F.col(f"_stats.b{i}")
        raw = F.floor(F.try_divide(quoted(c) - lo, hi - lo) * bins).cast("int")
        return F.when(quoted(c).isNotNull(), F.coalesce(F.least(raw, F.lit(bins - 1)), F.lit(0))).alias(c)

    binned = bound(df, "_stats", stats).select(F.col(label).alias("y"), *[slot(i, c) for i, c in enumerate(features)])
    cells = (
        binned.unpivot(["y"], [quoted(c) for c in features], "feature", "bin")
        .filter("bin is not null")
        .groupBy("feature", "bin", "y")
        .agg(F.count("*").alias("n"))
    )
    # From here on at most features x bins x classes rows.
    per_bin = cells.groupBy("feature", "bin").agg(F.sum("n").alias("n_bin"))
    per_y = cells.groupBy("feature", "y").agg(F.sum("n").alias("n_y"))
    per_f = cells.groupBy("feature").agg(F.sum("n").alias("n_all"))
    joined = cells.join(per_bin, ["feature", "bin"]).join(per_y, ["feature", "y"]).join(per_f, "feature")
    p = F.col("n") / F.col("n_all")
    term = p * F.ln(F.col("n").cast("double") * F.col("n_all") / (F.col("n_bin").cast("double") * F.col("n_y")))
    return joined.groupBy("feature").agg(F.sum(term).alias("mutual_information"))
