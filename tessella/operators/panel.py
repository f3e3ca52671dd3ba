"""Rectangular entity x month panels, presence, lifespans and silent entities.

A panel holds at most one row per (entity, month).  Per-entity windows over a
panel are therefore bounded by the length of the calendar, however many raw
records one entity has; raw records are always reduced to panel grain first.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.numeric import any_above
from tessella.session import materialize, one_row


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """First record per key in an explicit order.

    ``row_number() = 1`` plans a partial WindowGroupLimit before the shuffle,
    so a hot key ships one row per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def month_range(df: DataFrame, period: str) -> tuple[Column, Column]:
    """First and last month of a column as scalar values."""
    bounds = one_row(
        df,
        lo=F.trunc(F.min(period), "month"),
        hi=F.trunc(F.max(period), "month"),
    )
    return bounds["lo"], bounds["hi"]


def spine(entities: DataFrame, entity: str, period: str, lo: Column, hi: Column) -> DataFrame:
    """Every entity with every month in [lo, hi]; a generator, not a cross join."""
    months = F.sequence(lo, hi, F.expr("interval 1 month"))
    return entities.select(entity, F.explode(months).alias(period))


def union_keys(tables: list[DataFrame], cols: list[str]) -> DataFrame:
    """Distinct keys over several tables."""
    return reduce(DataFrame.unionAll, [t.select(*cols) for t in tables]).distinct()


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def build_panel(
    facts: Mapping[str, DataFrame], entity: str, period: str, min_gap: int | None = None, lagged: tuple[str, ...] = ()
) -> DataFrame:
    """Fact tables (unique per entity and month) on their common spine.

    Adds ``<type>_present`` flags and an overall ``present`` flag.  Each fact table
    is read once: its rows go, tagged, into one aggregation by entity, which is
    written; entities, the common bounds and the facts of every month come from
    there.  An entity's row holds its panel, so it is bounded by the calendar.

    ``min_gap`` adds the columns of ``flag_failures``; ``lagged`` adds, for columns
    of the facts, ``<column>_before``, the value of the month before, and
    ``panel_start``.  Both come from the entity's row: the panel is not sorted.
    """
    tables = list(facts.values())
    values = [[c for c in t.columns if c not in (entity, period)] for t in tables]

    def packed(t: DataFrame, i: int) -> Column:
        return F.struct(F.lit(1).alias(f"{i}_present"), *[F.col(c) for c in values[i]])

    types = [t.select(packed(t, i).alias("v")).schema["v"].dataType for i, t in enumerate(tables)]

    def tagged(t: DataFrame, i: int) -> DataFrame:
        own = [packed(t, i) if j == i else F.lit(None) for j in range(len(tables))]
        return t.select(entity, period, *[v.cast(types[j]).alias(f"_{j}") for j, v in enumerate(own)])

    stream = reduce(DataFrame.unionAll, [tagged(t, i) for i, t in enumerate(tables)])

    def by_month(j: int) -> Column:
        known = F.col(period).isNotNull() & F.col(entity).isNotNull() & F.col(f"_{j}").isNotNull()
        return F.map_from_entries(F.collect_list(F.when(known, F.struct(period, f"_{j}")))).alias(f"_{j}")

    per_entity = stream.groupBy(entity).agg(
        F.min(period).alias("_lo"), F.max(period).alias("_hi"), *[by_month(j) for j in range(len(tables))]
    )
    per_entity = materialize(per_entity, "panel-entities")
    bounds = one_row(per_entity, lo=F.trunc(F.min("_lo"), "month"), hi=F.trunc(F.max("_hi"), "month"))
    if min_gap is not None:
        months = F.flatten(F.array(*[F.map_keys(f"_{j}") for j in range(len(tables))]))
        last = F.array_max(F.filter(months, lambda m: m == F.trunc(m, "month")))
        silent = F.months_between(bounds["hi"], F.col("last_reporting_date"))
        per_entity = per_entity.withColumn("last_reporting_date", last).withColumn(
            "failure_date", F.when(silent >= min_gap, F.add_months("last_reporting_date", 1))
        )
    rows = per_entity.select(
        "*", F.explode(F.sequence(bounds["lo"], bounds["hi"], F.expr("interval 1 month"))).alias(period)
    )
    for j in range(len(tables) if lagged else 0):
        rows = rows.withColumn(f"_{j}_before", F.try_element_at(f"_{j}", F.add_months(period, -1)))
    for j in range(len(tables)):
        rows = rows.withColumn(f"_{j}", F.try_element_at(f"_{j}", F.col(period)))
    flags = {n: F.coalesce(F.col(f"_{j}.{j}_present"), F.lit(0)) for j, n in enumerate(facts)}
    columns = [F.col(entity), F.col(period)]
    for j, n in enumerate(facts):
        columns += [*[F.col(f"_{j}.{_quoted(c)}").alias(c) for c in values[j]], flags[n].alias(f"{n}_present")]
    any_flag = list(flags.values())
    columns.append((F.greatest(*any_flag) if len(any_flag) > 1 else any_flag[0]).alias("present"))
    if min_gap is not None:
        failed = F.coalesce(F.col(period) >= F.col("failure_date"), F.lit(False))
        columns += [F.col("last_reporting_date"), F.col("failure_date"), failed.cast("int").alias("failed")]
    if lagged:
        own = {c: j for j in range(len(tables)) for c in values[j]}
        columns += [F.col(f"_{own[c]}_before.{_quoted(c)}").alias(f"{c}_before") for c in lagged]
        columns.append(bounds["lo"].alias("panel_start"))
    return rows.select(*columns)


def flag_failures(
    panel: DataFrame, entity: str, period: str, present: str = "present", min_gap: int = 6
) -> DataFrame:
    """Annotate entities that fell silent for at least ``min_gap`` periods.

    ``failure_date`` is the month after the last report and ``failed`` marks
    rows from then on.
    """
    w = Window.partitionBy(entity)
    last = F.max(F.when(F.col(present) == 1, F.col(period))).over(w)
    silent = F.count(F.when(F.col(period) > F.col("last_reporting_date"), 1)).over(w)
    died = F.when(F.col("_silent") >= min_gap, F.add_months("last_reporting_date", 1))
    failed = F.coalesce(F.col(period) >= F.col("failure_date"), F.lit(False))
    return (
        panel.withColumn("last_reporting_date", last)
        .withColumn("_silent", silent)
        .withColumn("failure_date", died)
        .withColumn("failed", failed.cast("int"))
        .drop("_silent")
    )


def silent_entities(facts: DataFrame, entity: str, period: str, min_gap: int = 6) -> DataFrame:
    """Entity-level failure dates straight from facts, without the spine.

    One aggregation with map-side combine; the trailing gap is calendar
    arithmetic against the last month seen anywhere.
    """
    _, hi = month_range(facts, period)
    per_entity = facts.groupBy(entity).agg(
        F.trunc(F.min(period), "month").alias("first_reporting_date"),
        F.trunc(F.max(period), "month").alias("last_reporting_date"),
        F.count_distinct(F.trunc(period, "month")).alias("present_periods"),
    )
    gap = F.months_between(hi, F.col("last_reporting_date")).cast("int")
    return per_entity.withColumn("silent_periods", gap).withColumn(
        "failure_date", F.when(gap >= min_gap, F.add_months("last_reporting_date", 1))
    )


def entity_timeline(records: DataFrame, entity: str, period: str, kind: str) -> DataFrame:
    """First and last period and the set of record types per entity."""
    return records.groupBy(entity).agg(
        F.min(period).alias("first_seen"),
        F.max(period).alias("last_seen"),
        F.array_sort(F.collect_set(kind)).alias("types"),
    )


def lifespan(
    df: DataFrame, entity: str, period: str, refs: list[str], eps: float = 1e-9
) -> DataFrame:
    """First and last period in which any reference column has real data."""
    real = df.filter(any_above([F.col(c) for c in refs], eps))
    return real.groupBy(entity).agg(F.min(period).alias("start"), F.max(period).alias("end"))


def blank_outside(
    df: DataFrame,
    life: DataFrame,
    entity: str,
    period: str,
    cols: list[str],
    refs: list[str],
    eps: float = 1e-9,
    event: str | None = None,
) -> DataFrame:
    """Null ``cols`` outside the entity's lifespan, after its event date and on
    rows without real data.  The range test runs after an equi-join."""
    joined = df.join(life.select(entity, "start", "end"), entity, "left")
    alive = F.col(period).between(F.col("start"), F.col("end"))
    if event:
        alive = alive & F.coalesce(F.col(period) < F.col(event), F.lit(True))
    keep = alive & any_above([F.col(c) for c in refs], eps)
    return joined.withColumns({c: F.when(keep, F.col(c)) for c in cols}).drop("start", "end")


def entity_summary(panel: DataFrame, entity: str, period: str, present: str = "present") -> DataFrame:
    """Rows, present rows, reporting span and failure per entity."""
    seen = F.when(F.col(present) == 1, F.col(period))
    return panel.groupBy(entity).agg(
        F.count("*").alias("total_observations"),
        F.sum(present).alias("present_observations"),
        F.min(seen).alias("first_date"),
        F.max(seen).alias("last_date"),
        F.max("failed").alias("is_failed"),
        F.max("failure_date").alias("failure_date"),
        F.max("last_reporting_date").alias("last_reporting_date"),
    ).withColumn(
        "months_covered",
        F.months_between(F.col("last_date"), F.col("first_date")).cast("int") + 1,
    )


def period_summary(panel: DataFrame, entity: str, period: str, present: str = "present") -> DataFrame:
    """Entities, present entities, failed entities and availability per period.

    The panel is unique per (entity, period), so plain counts are distinct
    counts and combine map-side.
    """
    return panel.groupBy(period).agg(
        F.count(entity).alias("total_entities"),
        F.sum(present).alias("present_entities"),
        F.sum("failed").alias("failed_entities"),
        (F.avg(present) * 100).alias("availability_rate"),
    )


def dataset_metadata(panel: DataFrame, entity: str, period: str, present: str = "present") -> DataFrame:
    """One row: rows, distinct entities and periods, range, failures, availability.

    Grouped by entity first: the exact distinct count becomes a plain count.
    """
    per_entity = panel.groupBy(entity).agg(
        F.count("*").alias("n"),
        F.sum(present).alias("p"),
        F.max("failed").alias("f"),
        F.min(period).alias("lo"),
        F.max(period).alias("hi"),
    )
    return per_entity.agg(
        F.sum("n").alias("total_rows"),
        F.count("*").alias("entities"),
        F.min("lo").alias("first_period"),
        F.max("hi").alias("last_period"),
        F.sum("f").alias("failed_entities"),
        F.sum(1 - F.col("f")).alias("active_entities"),
        (F.sum("p") / F.sum("n") * 100).alias("availability_rate"),
    )


def period_coverage(found: DataFrame, period: str) -> DataFrame:
    """Expected against found months: range, counts, missing labels, ratio.

    The expected calendar and the list of gaps are bounded by the date range.
    """
    months = found.select(F.trunc(period, "month").alias("m")).distinct()
    s = months.agg(
        F.min("m").alias("lo"), F.max("m").alias("hi"), F.count("m").alias("found_months")
    )
    gaps = missing_periods(found, period).agg(
        F.array_sort(F.collect_list(F.date_format("missing_period", "yyyy-MM"))).alias("x")
    )
    expected = (F.months_between("hi", "lo") + 1).cast("int")
    return s.select(
        F.date_format("lo", "yyyy-MM").alias("start_month"),
        F.date_format("hi", "yyyy-MM").alias("end_month"),
        "found_months",
        expected.alias("expected_months"),
        F.array_join(gaps.scalar(), ",").alias("missing_months"),
        (F.col("found_months") / expected).alias("coverage_ratio"),
    )


def missing_periods(found: DataFrame, period: str) -> DataFrame:
    """Expected months that no record has (anti join against the calendar)."""
    months = found.select(F.trunc(period, "month").alias("missing_period")).distinct()
    bounds = months.agg(F.min("missing_period").alias("lo"), F.max("missing_period").alias("hi"))
    expected = bounds.select(
        F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("missing_period")
    )
    return expected.join(months, "missing_period", "left_anti")


def survivors(panel: DataFrame, failed: str = "failed") -> DataFrame:
    return panel.filter(F.col(failed) == 0)


def first_events(panel: DataFrame, entity: str, period: str, flag: str) -> DataFrame:
    """First period in which each entity's flag is set."""
    return (
        panel.filter(F.col(flag) == 1)
        .groupBy(entity)
        .agg(F.min(period).alias("event_date"))
    )


def events_per_period(panel: DataFrame, entity: str, period: str, flag: str) -> DataFrame:
    """First events per month over the whole calendar, zero-filled, with the
    running total (a window over one row per month)."""
    events = first_events(panel, entity, period, flag).groupBy(
        F.trunc("event_date", "month").alias(period)
    ).agg(F.count("*").alias("events"))
    bounds = panel.agg(
        F.trunc(F.min(period), "month").alias("lo"), F.trunc(F.max(period), "month").alias("hi")
    )
    calendar = bounds.select(
        F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias(period)
    )
    filled = calendar.join(events, period, "left").select(
        period, F.coalesce("events", F.lit(0)).cast("long").alias("events")
    )
    running = Window.orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    return filled.withColumn("cumulative_events", F.sum("events").over(running))
