"""Time series at daily, monthly, quarterly and annual grain on one calendar."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.numeric import safe_ratio


def quoted(name: str) -> Column:
    """Column by exact name, also when it holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def wide_to_long(
    df: DataFrame, ids: list[str], pattern: str, label: str = "label", value: str = "value"
) -> DataFrame:
    """Unpivot the columns whose names match; null cells are kept."""
    cols = [quoted(c) for c in df.columns if c not in ids and re.search(pattern, c)]
    return df.unpivot([quoted(i) for i in ids], cols, label, value)


def quarter_to_months(df: DataFrame, quarter_end: str, out: str = "date") -> DataFrame:
    """Repeat a quarterly value on its three month ends."""
    ends = F.transform(
        F.sequence(F.lit(0), F.lit(2)), lambda i: F.last_day(F.add_months(F.col(quarter_end), -i))
    )
    return df.withColumn(out, F.explode(ends))


def long_to_wide(
    df: DataFrame, keys: list[str], series: str, value: str, order: str, names: list[str]
) -> DataFrame:
    """One column per series, last non-null value per (key, series).

    The last value is picked by a partial-limit window, then one pivot with an
    explicit series list gives a single aggregation.
    """
    w = Window.partitionBy(*keys, series).orderBy(F.desc(order))
    last = (
        df.filter(F.col(value).isNotNull() & F.col(series).isin(names))
        .withColumn("_rn", F.row_number().over(w))
        .filter("_rn = 1")
    )
    return last.groupBy(*keys).pivot(series, names).agg(F.first(value))


def daily_to_monthly(df: DataFrame, day: str, value: str, out: str = "date") -> DataFrame:
    """Monthly mean labelled by month end; months without data give null."""
    monthly = df.groupBy(F.last_day(F.col(day).cast("date")).alias(out)).agg(
        F.avg(value).alias(value)
    )
    bounds = monthly.agg(
        F.trunc(F.min(out), "month").alias("lo"), F.trunc(F.max(out), "month").alias("hi")
    )
    calendar = bounds.select(
        F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("m")
    ).select(F.last_day("m").alias(out))
    return calendar.join(monthly, out, "left")


def mean_by_date(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def stack_series(parts: dict[str, tuple[DataFrame, str, str]], date: str = "date") -> DataFrame:
    """Stack (frame, value column, label) entries, keyed by series code."""
    frames = [
        df.select(
            F.col(date).alias("date"),
            F.lit(code).alias("series_code"),
            F.lit(text).alias("indicator"),
            quoted(value).alias("value"),
        )
        for code, (df, value, text) in parts.items()
    ]
    return reduce(DataFrame.unionByName, frames)


def outer_merge(frames: list[DataFrame], key: str) -> DataFrame:
    """Full outer merge of series on one key.

    Frames are stacked with null-filled columns and folded by one aggregation:
    a single shuffle instead of a chain of full outer joins.  Value columns of
    the same name are refused; a frame with a repeated key fails when it is read.
    """
    names = [c for f in frames for c in f.columns if c != key]
    if len(names) != len({n.lower() for n in names}):
        raise ValueError(f"frames share value columns: {sorted(n for n in set(names) if names.count(n) > 1)}")
    marks = [f"_in{i}" for i in range(len(frames))]
    frames = [f.withColumn(m, F.lit(1)) for f, m in zip(frames, marks)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    folded = stacked.groupBy(key).agg(
        *[F.max(quoted(c)).alias(c) for c in names], *[F.count(m).alias(m) for m in marks]
    )
    once = F.greatest(*marks, F.lit(0)) <= 1
    checked = F.when(once, F.col(key)).otherwise(F.raise_error(F.lit(f"a frame repeats a value of {key}")))
    return folded.withColumn(key, checked.cast(folded.schema[key].dataType)).drop(*marks)


def rename_from_lookup(
    df: DataFrame, lookup: DataFrame, code: str, label: str, order: str | None = None
) -> DataFrame:
    """Replace series codes by display names; unknown codes stay.

    Of several names of a code the one latest in ``order`` is taken, or, without
    an order, the greatest name.
    """
    latest = F.max_by(label, order) if order else F.max(label)
    names = lookup.groupBy(code).agg(latest.alias(label))
    return df.join(names, code, "left").withColumn(label, F.coalesce(label, code))


def align_month_end(df: DataFrame, date: str, out: str = "date_m") -> DataFrame:
    """Month-start and month-end sources onto one month-end key."""
    return df.withColumn(out, F.last_day(F.col(date).cast("date")))


def join_mixed_grain(
    panel: DataFrame, period: str, annual: DataFrame, monthly: DataFrame
) -> DataFrame:
    """Left-join annual rows by ``year`` and monthly rows by ``year_month``."""
    keyed = panel.withColumns(
        {"year": F.year(period), "year_month": F.date_format(period, "yyyy-MM")}
    )
    return keyed.join(annual, "year", "left").join(monthly, "year_month", "left")


def pct_change(df: DataFrame, series: list[str], order: str, value: str, out: str) -> DataFrame:
    """Percent change against the previous observation of the same series.

    Series hold one row per date (see ``mean_by_date``), so a partition is
    bounded by the calendar.
    """
    before = F.lag(value).over(Window.partitionBy(*series).orderBy(order))
    return df.withColumn(out, (safe_ratio(F.col(value), before) - 1) * 100)


def relative_to(
    df: DataFrame, reference: DataFrame, key: str, value: str, ref_value: str, out: str
) -> DataFrame:
    """Series divided by a reference series on a shared key."""
    ref = reference.select(key, F.col(ref_value).alias("_ref"))
    joined = df.join(ref, key, "left")
    return joined.withColumn(out, safe_ratio(F.col(value), F.col("_ref"))).drop("_ref")


def fill_both_ways(df: DataFrame, keys: list[str], order: str, cols: list[str]) -> DataFrame:
    """Forward fill, then back fill, within a group in period order."""
    w = Window.partitionBy(*keys).orderBy(order)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    filled = {
        c: F.coalesce(
            F.last(quoted(c), ignorenulls=True).over(past),
            F.first(quoted(c), ignorenulls=True).over(ahead),
        )
        for c in cols
    }
    return df.withColumns(filled)
