"""Profiles, distributions and validation reports."""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.features import zscore
from tessella.operators.quantiles import percentiles
from tessella.operators.series import quoted
from tessella.session import bound, one_row

# Entity cells that contain one of these are aggregate rows.
AGGREGATE_WORDS = [
    "total",
    "sum",
    "всього",
    "разом",
    "банки",
    "banks",
    "state-owned",
    "privately",
    "foreign",
    "insolvent",
]

# Statement type by column prefix.
STATEMENT_PREFIXES = ["assets_", "liabilities_", "equity_", "financial_results_"]


def _per_column(df: DataFrame, cols: list[str], fields) -> DataFrame:
    """One row per column from a single aggregation over all of them."""
    rows = [
        F.struct(F.lit(c).alias("column_name"), *[e.alias(n) for n, e in fields(quoted(c)).items()])
        for c in cols
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def missing_rates(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return _per_column(
        df,
        cols or df.columns,
        lambda c: {
            "missing": F.count(F.when(c.isNull(), 1)),
            "missing_pct": F.avg(c.isNull().cast("int")) * 100,
        },
    )


def overall_missing_rate(df: DataFrame, cols: list[str]) -> DataFrame:
    """Share of empty cells over all the columns together."""
    empty = reduce(lambda a, b: a + b, [quoted(c).isNull().cast("int") for c in cols])
    return df.agg((F.sum(empty) / (F.count("*") * len(cols)) * 100).alias("missing_pct"))


DESCRIBE_PROBS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, deviation, range, exact percentiles and missing share."""
    basic = _per_column(
        df,
        cols,
        lambda c: {
            "n": F.count(c),
            "mean": F.avg(c),
            "std": F.stddev_samp(c),
            "min": F.min(c).cast("double"),
            "max": F.max(c).cast("double"),
            "missing": F.count(F.when(c.isNull(), 1)),
            "missing_pct": F.avg(c.isNull().cast("int")) * 100,
        },
    )
    wide = percentiles(df, cols, DESCRIBE_PROBS).groupBy("column_name").agg(
        *[
            F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"p{round(p * 100)}")
            for p in DESCRIBE_PROBS
        ]
    )
    return basic.join(wide, "column_name", "left")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows and percent per class; the total comes from the class counts."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = one_row(counts, t=F.sum("n"))["t"]
    return counts.withColumn("pct", F.col("n") / total * 100)


def dispersion(df: DataFrame, period: str, cols: list[str]) -> DataFrame:
    """Cross-sectional spread: per period the population deviation of the
    standardised column, averaged over periods, ranked."""
    z = zscore(df, cols, ddof=0)
    per_period = z.groupBy(period).agg(
        *[F.stddev_pop(quoted(f"{c}_z")).alias(c) for c in cols]
    )
    means = _per_column(per_period, cols, lambda c: {"dispersion": F.avg(c)})
    return means.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("dispersion"), "column_name"))
    )  # one row per column


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete Pearson correlations as (column_a, column_b, corr)."""
    pairs = [
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.corr(quoted(a), quoted(b)).alias("corr"))
        for a, b in combinations_with_replacement(cols, 2)
    ]
    half = df.agg(F.array(*pairs).alias("r")).select(F.inline("r"))
    mirrored = half.filter("column_a <> column_b").select(
        F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "corr"
    )
    return half.unionByName(mirrored)


def between_share(df: DataFrame, entity: str, cols: list[str]) -> DataFrame:
    """Share of each column's variance that lies between entity means.

    Entities are reduced to (n, mean, squares within) first, so a hot entity only
    costs partial sums; squares between are summed around the overall mean.  No
    sum of squares is taken from raw values, so a large offset does no harm.
    """
    aggs: list[Column] = []
    for i, c in enumerate(cols):
        aggs += [
            F.count(quoted(c)).alias(f"n{i}"),
            F.avg(quoted(c)).alias(f"m{i}"),
            (F.var_pop(quoted(c)) * F.count(quoted(c))).alias(f"w{i}"),
        ]
    per_entity = df.groupBy(entity).agg(*aggs)
    # means around the smallest one, so that their weighted mean keeps its digits
    low = one_row(per_entity, **{f"l{i}": F.min(f"m{i}") for i in range(len(cols))})
    near = bound(per_entity, "_low", low)
    near = near.withColumns({f"m{i}": F.col(f"m{i}") - F.col(f"_low.l{i}") for i in range(len(cols))})
    mean = one_row(near, **{f"c{i}": F.try_divide(F.sum(F.col(f"n{i}") * F.col(f"m{i}")), F.sum(f"n{i}")) for i in range(len(cols))})
    centred = bound(near, "_mean", mean)
    rows = []
    for i, c in enumerate(cols):
        gap = F.col(f"m{i}") - F.col(f"_mean.c{i}")
        between = F.sum(F.col(f"n{i}") * gap * gap)
        rows.append(
            F.struct(
                F.lit(c).alias("column_name"), F.try_divide(between, between + F.sum(f"w{i}")).alias("between_share")
            )
        )
    return centred.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def range_violations(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Values below or above the allowed range of each column."""
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.count(F.when(quoted(c) < lo, 1)).alias("below"),
            F.count(F.when(quoted(c) > hi, 1)).alias("above"),
        )
        for c, (lo, hi) in bounds.items()
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def coverage(df: DataFrame, cols: list[str], required: float = 0.75) -> DataFrame:
    """Non-null share of each column and whether it is high enough."""
    return _per_column(df, cols, lambda c: {"coverage": F.avg(c.isNotNull().cast("int"))}).withColumn(
        "sufficient", F.col("coverage") >= required
    )


def distinct_counts(df: DataFrame, cols: list[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column.

    The exact form counts (column, value) pairs after a map-side distinct, so
    the columns share one shuffle spread over all their values.
    """
    if approximate:
        return _per_column(df, cols, lambda c: {"distinct_values": F.approx_count_distinct(c)})
    pairs = (
        df.select(*[quoted(c).cast("string").alias(c) for c in cols])
        .unpivot([], [quoted(c) for c in cols], "column_name", "v")
        .filter(F.col("v").isNotNull())
        .distinct()
    )
    return pairs.groupBy("column_name").agg(F.count("*").alias("distinct_values"))


def trend_line(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares slope and intercept of y on x."""
    grouped = df.groupBy(*keys) if keys else df
    return grouped.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
    )


def period_mean(df: DataFrame, period: str, measure: str, attribute: str) -> DataFrame:
    """Mean of a measure with the period-level attribute beside it."""
    return df.groupBy(period).agg(
        F.avg(measure).alias(f"mean_{measure}"), F.min(attribute).alias(attribute)
    )


# ---------------------------------------------------------------- validation


def required_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """One row per required column; the check itself is schema metadata."""
    have = set(df.columns)
    checks = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.lit(c in have).alias("found")) for c in required]
    )
    return df.agg(F.count("*").alias("table_rows")).select("table_rows", F.inline(checks))


def null_key_check(df: DataFrame, keys: list[str], cols: list[str], max_null: float = 0.5) -> DataFrame:
    """Null counts of keys, and columns whose null share is too high."""
    return _per_column(
        df,
        keys + cols,
        lambda c: {"nulls": F.count(F.when(c.isNull(), 1)), "null_share": F.avg(c.isNull().cast("int"))},
    ).withColumn(
        "issue",
        F.when(F.col("column_name").isin(keys) & (F.col("nulls") > 0), "null_key")
        .when(~F.col("column_name").isin(keys) & (F.col("null_share") > max_null), "mostly_null")
        .otherwise("ok"),
    )


def entity_count_check(df: DataFrame, entity: str, minimum: int, low: int, high: int) -> DataFrame:
    names = df.select(entity).filter(F.col(entity).isNotNull()).distinct()
    n = F.col("entities")
    return names.agg(F.count("*").alias("entities")).select(
        "entities",
        F.when(n < minimum, "low").otherwise("good").alias("diversity"),
        F.when(n > high, "above").when(n < low, "below").otherwise("in_range").alias("range_status"),
    )


def date_validity(df: DataFrame, text: str, fmt: str = "yyyy-MM-dd") -> DataFrame:
    """Rows whose text is no date of the expected form."""
    parsed = F.try_to_timestamp(F.col(text), F.lit(fmt))
    return df.agg(
        F.count("*").alias("table_rows"),
        F.count(F.when(F.col(text).isNull() | parsed.isNull(), 1)).alias("invalid_dates"),
    )


def availability_band(df: DataFrame, keys: list[str], present: str) -> DataFrame:
    """Share of present rows, banded at 10 and 30 percent."""
    rate = F.col("availability")
    grouped = df.groupBy(*keys) if keys else df
    return grouped.agg(F.avg(present).alias("availability")).withColumn(
        "band", F.when(rate < 0.1, "critical").when(rate < 0.3, "warning").otherwise("acceptable")
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def batch_statistics(df: DataFrame, kind: str, empty: Column) -> DataFrame:
    """Rows and empty rows per record type, with the average over types."""
    per = df.groupBy(kind).agg(
        F.count("*").alias("n_rows"), F.count(F.when(empty, 1)).alias("empty_rows")
    )
    mean = one_row(per, m=F.avg("n_rows"))["m"]
    return per.withColumn("average_rows", mean)


def schema_drift(snapshots: DataFrame, snapshot: str, column: str) -> DataFrame:
    """Columns per snapshot and prefix class, and twins after normalisation.

    Input: one row per (snapshot, column name).  Two names of one snapshot are
    twins when they agree after normalising and folding look-alike letters.
    """
    from tessella.functions.text import fold_homoglyphs, normalize_name

    norm = normalize_name(fold_homoglyphs(F.col(column)))
    kind = F.lit("other")
    for p in reversed(STATEMENT_PREFIXES):
        kind = F.when(norm.startswith(p), p.rstrip("_")).otherwise(kind)
    named = snapshots.select(snapshot, column, norm.alias("norm"), kind.alias("column_class")).distinct()
    per_norm = named.groupBy(snapshot, "column_class", "norm").agg(F.count("*").alias("n"))
    return per_norm.groupBy(snapshot, "column_class").agg(
        F.sum("n").alias("columns"), F.sum(F.col("n") - 1).alias("twins")
    )


def consolidation_report(
    before: DataFrame, after: DataFrame, entity: str, period: str, mapping: DataFrame
) -> DataFrame:
    """Entities, rows and duplicate keys before and after, mappings applied."""

    def side(df: DataFrame) -> Column:
        per_key = df.groupBy(entity, period).agg(F.count("*").alias("n"))
        per_entity = per_key.groupBy(entity).agg(
            F.sum("n").alias("n"), F.count(F.when(F.col("n") > 1, 1)).alias("dup")
        )
        return one_row(per_entity, entities=F.count("*"), rows=F.sum("n"), dup=F.sum("dup"))

    b, a = side(before), side(after)
    applied = (
        before.select(F.col(entity).alias("variant")).distinct().join(mapping, "variant", "left_semi")
    )
    return applied.agg(F.count("*").alias("mappings_applied")).select(
        "mappings_applied",
        b["entities"].alias("entities_before"),
        a["entities"].alias("entities_after"),
        b["rows"].alias("rows_before"),
        a["rows"].alias("rows_after"),
        b["dup"].alias("duplicates_before"),
        a["dup"].alias("duplicates_after"),
    )


def event_preservation(before: DataFrame, after: DataFrame, flag: str) -> DataFrame:
    total = one_row(after, s=F.sum(flag))["s"]
    return before.agg(F.sum(flag).alias("events_before")).select(
        "events_before",
        total.alias("events_after"),
        (F.col("events_before") == total).alias("preserved"),
    )


def cutoff_reconciliation(df: DataFrame, period: str, cutoff: str) -> DataFrame:
    """Rows before and after a cutoff date, from one scan."""
    kept = F.col(period) >= F.lit(cutoff).cast("date")
    return df.agg(
        F.count("*").alias("rows_before"), F.count(F.when(kept, 1)).alias("rows_after")
    ).withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))
