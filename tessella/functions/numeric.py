"""Column expressions for ratios and guarded arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(num: Column, den: Column) -> Column:
    """Null when either side is null or the denominator is zero."""
    return F.try_divide(num, den)


def sum_skip_null(parts: list[Column]) -> Column:
    """Row-wise sum in which a null counts as zero."""
    return reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])


def sum_ratio(parts: list[Column], den: Column) -> Column:
    return safe_ratio(sum_skip_null(parts), den)


def log_size(amount: Column) -> Column:
    """Natural log of a positive amount; zero and below have no log."""
    return F.when(amount > 0, F.ln(amount))


def clip(value: Column, lo: Column | float, hi: Column | float) -> Column:
    """Bound a value; null stays null although greatest/least skip nulls."""
    lo, hi = (b if isinstance(b, Column) else F.lit(b) for b in (lo, hi))
    return F.when(value.isNotNull(), F.greatest(F.least(value, hi), lo))


def regime_flag(day: Column, start: str) -> Column:
    return (day >= F.lit(start).cast("date")).cast("int")


def spread(a: Column, b: Column) -> Column:
    return a - b


def any_above(cols: list[Column], eps: float) -> Column:
    """True when any column exceeds ``eps``; nulls count as not above."""
    return reduce(lambda a, b: a | b, [F.coalesce(c > eps, F.lit(False)) for c in cols])


def all_present(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])


def is_infinite(value: Column) -> Column:
    return value.isin(float("inf"), float("-inf"))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)
