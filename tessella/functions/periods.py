"""Column expressions for period keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Period labels found in file names and headers.
FILE_PERIOD = r"(\d{4})[^\d]?(\d{2})"
QUARTER_LABEL = r"(\d{4})Q([1-4])"
MONTH_LABEL = r"^(\d{4})-M(\d{2})$"
YEAR_LABEL = r"^(\d{4})$"


def month_start(day: Column) -> Column:
    return F.trunc(day.cast("date"), "month")


def month_end(day: Column) -> Column:
    return F.last_day(day.cast("date"))


def year_month(day: Column) -> Column:
    return F.date_format(day.cast("date"), "yyyy-MM")


def to_period(day: Column, how: str) -> Column:
    """``start`` | ``end`` | ``label`` form of the month of a day."""
    forms = {"start": month_start, "end": month_end, "label": year_month}
    return forms[how](day)


def _parts(text: Column, pattern: str) -> tuple[Column, Column]:
    year = F.regexp_extract(text, pattern, 1).try_cast("int")
    part = F.regexp_extract(text, pattern, 2).try_cast("int")
    return year, part


def period_from_name(name: Column) -> Column:
    """First year-month in a file name, as first of month (null if none)."""
    year, month = _parts(name, FILE_PERIOD)
    return F.when(month.between(1, 12), F.make_date(year, month, F.lit(1)))


def quarter_end(label: Column) -> Column:
    """``2016Q4 [YR2016Q4]`` to the last day of that quarter."""
    year, quarter = _parts(label, QUARTER_LABEL)
    return F.last_day(F.make_date(year, quarter * 3, F.lit(1)))


def month_from_label(label: Column) -> Column:
    """``2019-M01`` to the first of that month."""
    year, month = _parts(label, MONTH_LABEL)
    return F.when(month.between(1, 12), F.make_date(year, month, F.lit(1)))


def year_from_label(label: Column) -> Column:
    """``2016`` to 1 January of that year."""
    year = F.regexp_extract(label, YEAR_LABEL, 1).try_cast("int")
    return F.make_date(year, F.lit(1), F.lit(1))


def calendar_parts(day: Column) -> dict[str, Column]:
    return {"year": F.year(day), "quarter": F.quarter(day), "month": F.month(day)}
