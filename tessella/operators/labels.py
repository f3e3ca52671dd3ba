"""Early-warning labels, time splits and time-ordered folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def early_warning_labels(
    df: DataFrame, period: str, failure_date: str = "failure_date", horizons: tuple[int, ...] = (1, 6)
) -> DataFrame:
    """``post_failure`` and ``will_fail_within_<h>m`` for every horizon."""
    day, died = F.col(period), F.col(failure_date)
    out = {"post_failure": F.coalesce(day >= died, F.lit(False))}
    for h in horizons:
        soon = (day < died) & (died <= F.add_months(day, h))
        out[f"will_fail_within_{h}m"] = F.coalesce(soon, F.lit(False)).cast("int")
    return df.withColumns(out)


def drop_post_event(df: DataFrame, flag: str = "post_failure") -> DataFrame:
    return df.filter(~F.col(flag))


def split_tag(df: DataFrame, period: str, date: str, out: str = "split") -> DataFrame:
    """Tag rows ``train`` up to and including a date and ``test`` after it."""
    early = F.col(period) <= F.lit(date).cast("date")
    return df.withColumn(out, F.when(early, "train").otherwise("test"))


def time_split(df: DataFrame, period: str, date: str) -> tuple[DataFrame, DataFrame]:
    cut = F.lit(date).cast("date")
    return df.filter(F.col(period) <= cut), df.filter(F.col(period) > cut)


def _numbered_periods(df: DataFrame, period: str) -> DataFrame:
    """Distinct months numbered from 0; one row per month of the calendar."""
    months = df.select(F.last_day(period).alias("month")).distinct()
    return months.select(
        "month",
        (F.row_number().over(Window.orderBy("month")) - 1).alias("idx"),
        F.count("*").over(Window.partitionBy(F.lit(0))).alias("n_months"),
    )


def period_slices(df: DataFrame, period: str, n: int) -> DataFrame:
    """(month, slice): n slices with edges at floor(i * months / n)."""
    months = _numbered_periods(df, period)
    edges = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.floor(i * F.col("n_months") / F.lit(n)),
    )
    slot = F.size(F.filter(edges, lambda e: e <= F.col("idx"))) - 1
    return months.select("month", slot.alias("slice"))


def expanding_folds(df: DataFrame, period: str, min_train: int, n_folds: int) -> DataFrame:
    """(fold, train_end, val_month): train up to a month, validate on the next."""
    months = _numbered_periods(df, period)
    nxt = F.lead("month").over(Window.orderBy("idx"))
    fold = F.col("idx") - (min_train - 1) + 1
    last = F.least(F.lit(n_folds), F.greatest(F.lit(1), F.col("n_months") - min_train))
    return (
        months.withColumn("val_month", nxt)
        .withColumn("fold", fold)
        .filter(fold.between(1, last) & F.col("val_month").isNotNull())
        .select("fold", F.col("month").alias("train_end"), "val_month")
    )


def fold_rows(df: DataFrame, period: str, folds: DataFrame) -> DataFrame:
    """Rows per fold tagged train or validate.

    The fold table has at most ``n_folds`` rows; it is carried to the rows as
    one scalar array, exploded where a row takes part.
    """
    packed = folds.agg(
        F.collect_list(F.struct("fold", "train_end", "val_month")).alias("f")
    ).scalar()
    month = F.last_day(period)
    mine = F.filter("_folds", lambda f: (month <= f["train_end"]) | (month == f["val_month"]))
    return (
        df.withColumn("_folds", packed)
        .withColumn("_fold", F.explode(mine))
        .withColumn("fold", F.col("_fold.fold"))
        .withColumn("role", F.when(month <= F.col("_fold.train_end"), "train").otherwise("validate"))
        .drop("_fold", "_folds")
    )


def block_fold_rows(df: DataFrame, period: str, min_train: int, n_folds: int) -> DataFrame:
    """Rows per fold tagged train or validate, every later month validated once.

    The months after the first ``min_train`` are cut into ``n_folds`` consecutive
    blocks; a fold validates one block and trains on all months before it.
    """
    months = _numbered_periods(df, period)
    later = F.greatest(F.col("n_months") - min_train, F.lit(1))
    block = F.greatest(F.floor((F.col("idx") - min_train) * n_folds / later) + 1, F.lit(0)).cast("int")
    blocks = months.select(F.col("month").alias("_month"), block.alias("_block"))
    placed = df.join(F.broadcast(blocks), F.last_day(period) == F.col("_month"))  # one row per month
    folds = F.sequence(F.greatest(F.col("_block"), F.lit(1)), F.lit(n_folds))
    return (
        placed.withColumn("fold", F.explode(folds))
        .withColumn("role", F.when(F.col("fold") == F.col("_block"), "validate").otherwise("train"))
        .drop("_month", "_block")
    )
