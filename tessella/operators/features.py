"""Lagged, rolling, scaled and imputed features.

Lags and windows count calendar months, whether the rows form a rectangular
panel or have gaps: a month without a row gives a null lag and no value to a
rolling window.  Rows are unique per (entity, month).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.numeric import clip, is_infinite
from tessella.operators.quantiles import percentile_map
from tessella.operators.series import quoted
from tessella.session import bound, one_row, shuffle_partitions


def month_window(df: DataFrame, entity: str, period: str) -> WindowSpec:
    """An entity's rows by month number; frames on it are in months.

    A numeric period counts periods itself.
    """
    numbered = isinstance(df.schema[period].dataType, T.NumericType)
    number = F.col(period) if numbered else F.year(period) * 12 + F.month(period)
    return Window.partitionBy(entity).orderBy(number)


def add_lags(df: DataFrame, entity: str, period: str, cols: list[str], lags: list[int]) -> DataFrame:
    """``<col>_lag<k>``: the value k months earlier, over one shared sort.

    A negative k looks ahead.
    """
    w = month_window(df, entity, period)
    new = {f"{c}_lag{k}": F.first(quoted(c)).over(w.rangeBetween(-k, -k)) for c in cols for k in lags}
    return df.withColumns(new)


def add_rolling(
    df: DataFrame, entity: str, period: str, cols: list[str], windows: list[int]
) -> DataFrame:
    """``<col>_ma<w>`` and ``<col>_std<w>`` over the last w months, this one
    included, with max(1, w // 2) values needed."""
    new: dict[str, Column] = {}
    for size in windows:
        w = month_window(df, entity, period).rangeBetween(-(size - 1), 0)
        for c in cols:
            enough = F.count(quoted(c)).over(w) >= max(1, size // 2)
            new[f"{c}_ma{size}"] = F.when(enough, F.avg(quoted(c)).over(w))
            new[f"{c}_std{size}"] = F.when(enough, F.stddev_samp(quoted(c)).over(w))
    return df.withColumns(new)


def zscore(df: DataFrame, cols: list[str], ddof: int = 1) -> DataFrame:
    """``<col>_z`` with global mean and deviation; zero where it is constant."""
    std = F.stddev_samp if ddof == 1 else F.stddev_pop
    aggs = {f"m{i}": F.avg(quoted(c)) for i, c in enumerate(cols)}
    aggs |= {f"s{i}": std(quoted(c)) for i, c in enumerate(cols)}
    with_stats = bound(df, "_stats", one_row(df, **aggs))
    new = {}
    for i, c in enumerate(cols):
        mean, dev = F.col(f"_stats.m{i}"), F.col(f"_stats.s{i}")
        flat = F.when(quoted(c).isNotNull(), F.lit(0.0))
        new[f"{c}_z"] = F.when(dev > 0, (quoted(c) - mean) / dev).otherwise(flat)
    return with_stats.withColumns(new).drop("_stats")


def fit_impute(train: DataFrame, cols: list[str]) -> Column:
    """Exact train medians as a scalar map (absent for an all-null column)."""
    return percentile_map(train, cols, [0.5])


def apply_impute(df: DataFrame, medians: Column, cols: list[str]) -> DataFrame:
    filled = {
        c: F.coalesce(
            quoted(c).cast("double"), F.try_element_at("_medians", F.lit(c))[0], F.lit(0.0)
        )
        for c in cols
    }
    return bound(df, "_medians", medians).withColumns(filled).drop("_medians")


def fit_scale(train: DataFrame, cols: list[str]) -> Column:
    """Train mean and population deviation of each column as one struct."""
    aggs = {f"m{i}": F.avg(quoted(c)) for i, c in enumerate(cols)}
    aggs |= {f"s{i}": F.stddev_pop(quoted(c)) for i, c in enumerate(cols)}
    return one_row(train, **aggs)


def apply_scale(df: DataFrame, stats: Column, cols: list[str], with_mean: bool = True) -> DataFrame:
    """Standardise; a constant column is divided by one."""
    new = {}
    for i, c in enumerate(cols):
        s = F.col(f"_stats.s{i}")
        dev = F.when(s > 0, s).otherwise(F.lit(1.0))
        centre = F.col(f"_stats.m{i}") if with_mean else F.lit(0.0)
        new[c] = (quoted(c) - centre) / dev
    return bound(df, "_stats", stats).withColumns(new).drop("_stats")


def preprocess(
    train: DataFrame, frames: list[DataFrame], cols: list[str], amounts: list[str]
) -> list[DataFrame]:
    """Impute, log1p amount columns, standardise; all statistics from ``train``."""
    medians = fit_impute(train, cols)

    def log_amounts(df: DataFrame) -> DataFrame:
        filled = apply_impute(df, medians, cols)
        return filled.withColumns(
            {c: F.coalesce(F.log1p(quoted(c)), F.lit(0.0)) for c in cols if c in amounts}
        )

    stats = fit_scale(log_amounts(train), cols)
    return [apply_scale(log_amounts(df), stats, cols) for df in frames]


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Balanced weights n / (2 n_c)."""
    counted = bound(df, "_s", one_row(df, n=F.count(label), pos=F.sum(F.col(label).cast("long"))))
    size = F.when(F.col(label) == 1, F.col("_s.pos")).otherwise(F.col("_s.n") - F.col("_s.pos"))
    return counted.withColumn(out, F.try_divide(F.col("_s.n").cast("double"), size * 2)).drop("_s")


def downsample_negatives(
    df: DataFrame, label: str, keys: list[str], ratio: int, seed: int, groups: list[str] | None = None
) -> DataFrame:
    """All positives and the ``ratio * positives`` negatives with lowest hash.

    With ``groups``, a short list (folds), every group is sampled on its own, all of
    them in the same passes.

    A seeded hash of the row's keys orders the negatives, so the sample is the
    same on every run and its size is exact.  The global order is split in hash
    ranges, sixteen and more per shuffle partition: only the one range that holds
    the cut is ranked.
    """
    groups = list(groups or [])
    bits = max(12, (16 * shuffle_partitions(df) - 1).bit_length())
    marked = df.withColumn("_h", F.xxhash64(F.lit(seed), *keys)).withColumn(
        "_range", F.shiftright("_h", 64 - bits) + F.lit(1 << (bits - 1))
    )
    counts = marked.groupBy(*groups, "_range").agg(
        F.count(F.when(F.col(label) == 0, 1)).alias("_n"), F.sum(F.col(label).cast("long")).alias("_pos")
    )
    each = Window.partitionBy(*groups)
    before = F.sum("_n").over(each.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(
        *groups, "_range", "_n", F.coalesce(before, F.lit(0)).alias("_before"),
        (F.sum("_pos").over(each) * ratio).alias("_quota"),
    )
    placed = marked.join(F.broadcast(offsets), [*groups, "_range"])  # at most 2 ** bits rows a group
    quota, negative = F.col("_quota"), F.col(label) == 0
    whole = placed.filter((F.col(label) == 1) | (negative & (F.col("_before") + F.col("_n") <= quota)))
    w = Window.partitionBy(*groups, "_range").orderBy("_h", *keys)
    cut = (
        placed.filter(negative & (F.col("_before") < quota) & (F.col("_before") + F.col("_n") > quota))
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_before") + F.col("_rn") <= quota)
    )
    cols = df.columns
    return whole.select(*cols).unionByName(cut.select(*cols))


def usable_columns(df: DataFrame, cols: list[str], min_share: float = 0.5) -> DataFrame:
    """Columns with enough values, some variance and no infinities.

    One aggregation over all columns, then one row per column.
    """
    per_col = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.avg(quoted(c).isNotNull().cast("int")).alias("non_null_share"),
            F.stddev_samp(F.when(~is_infinite(quoted(c)), quoted(c))).alias("deviation"),
            F.coalesce(F.max(is_infinite(quoted(c))), F.lit(False)).alias("has_infinite"),
        )
        for c in cols
    ]
    wide = df.agg(F.array(*per_col).alias("stats"))
    rows = wide.select(F.inline("stats"))
    good = (F.col("non_null_share") >= min_share) & (F.col("deviation") > 0) & ~F.col("has_infinite")
    return rows.withColumn("usable", F.coalesce(good, F.lit(False)))


# Columns that identify rows or reveal the outcome.
NON_FEATURES = [
    "bank_name",
    "date",
    "date_m",
    "year_month",
    "processing_timestamp",
    "failure_date",
    "last_reporting_date",
    "post_failure",
    "failed",
    "will_fail_within_1m",
    "will_fail_within_6m",
]


def feature_columns(
    df: DataFrame, ids: list[str], guard: str = r"(?i)fail", non_features: list[str] | None = None
) -> DataFrame:
    """Numeric, non-constant columns that are no id, label or leak.

    Types and names come from the schema; constancy is one min/max aggregate.
    A null beside one value still counts as varying.
    """
    import re

    banned = {*ids, *(NON_FEATURES if non_features is None else non_features)}
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")
    names = [
        c
        for c, t in df.dtypes
        if t.startswith(numeric)
        and c not in banned
        and not c.endswith("_present")
        and not re.search(guard, c)
    ]
    per_col = [
        F.struct(
            F.lit(c).alias("column_name"),
            (
                (F.min(quoted(c)) < F.max(quoted(c)))
                | ((F.count(quoted(c)) < F.count(F.lit(1))) & (F.count(quoted(c)) > 0))
            ).alias("varies"),
        )
        for c in names
    ]
    return (
        df.agg(F.array(*per_col).alias("stats"))
        .select(F.inline("stats"))
        .filter("varies")
        .select("column_name")
    )


def drop_matching(
    df: DataFrame, prefixes: tuple[str, ...] = (), suffixes: tuple[str, ...] = (), regex: str | None = None
) -> DataFrame:
    """Drop columns by prefix, suffix or pattern, and ``_z`` twins of kept bases."""
    import re

    gone = [
        c
        for c in df.columns
        if c.startswith(prefixes)
        or c.endswith(suffixes)
        or (regex and re.search(regex, c))
        or (c.endswith("_z") and c[:-2] in df.columns)
    ]
    return df.drop(*gone)


def winsorize(df: DataFrame, cols: list[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Clip to exact [lo, hi] percentiles; ``<col>_clipped`` marks changed rows."""
    with_bounds = bound(df, "_bounds", percentile_map(df, cols, [lo, hi]))
    new = {}
    for c in cols:
        pair = F.try_element_at("_bounds", F.lit(c))
        new[c] = clip(quoted(c), pair[0], pair[1])
        new[f"{c}_clipped"] = F.coalesce(
            (quoted(c) < pair[0]) | (quoted(c) > pair[1]), F.lit(False)
        )
    return with_bounds.withColumns(new).drop("_bounds")


# Column names that suggest a date, and preferred target names.
DATE_NAMES = r"(?i)(date|period|month|report|time|ym)"
TARGET_NAMES = ["failed", "target_next", "target", "label_next", "label", "default", "event"]


#: Relative error of the distinct sketches in ``detect_roles``, and how many
#: of it an estimate is trusted to be off by at most.
SKETCH_ERROR, SKETCH_MARGIN = 0.01, 5


def detect_roles(df: DataFrame) -> DataFrame:
    """Guess the date, id and 0/1 target column.

    Candidates come from the schema.  One scan gives the rows, the months, which
    columns are 0/1 and a mergeable distinct sketch of every column; no value is
    shuffled.  The id column has the distinct count nearest to rows per month,
    text columns being favoured; columns whose sketches leave open which is nearest
    are counted exactly.
    """
    import re

    from tessella.operators.quality import distinct_counts

    dates = [c for c, t in df.dtypes if t in ("date", "timestamp", "timestamp_ntz")]
    named = [c for c in dates if re.search(DATE_NAMES, c)] or dates
    if not named:
        raise ValueError("no date column")
    date = named[0]
    numeric = [c for c, t in df.dtypes if t in ("int", "bigint", "boolean", "smallint", "tinyint")]
    text = [c for c, t in df.dtypes if t == "string"]
    others = [c for c in df.columns if c != date]
    seen = df.agg(
        F.count("*").alias("rows"),
        F.size(F.collect_set(F.trunc(date, "month"))).alias("months"),
        F.array(*[F.coalesce(F.min(quoted(c).cast("long").isin(0, 1).cast("int")) == 1, F.lit(False)) for c in numeric]).alias("binary"),
        F.array(*[F.approx_count_distinct(quoted(c), SKETCH_ERROR) for c in others]).alias("distinct"),
    ).first()
    rows, months = seen["rows"], seen["months"]
    targets = [c for c, yes in zip(numeric, seen["binary"] or []) if yes]
    place = {n: i for i, n in enumerate(TARGET_NAMES)}
    target = min(targets, key=lambda c: place.get(c.lower(), len(place)), default=None)
    guess = max(1, round(rows / max(1, months)))

    def gap(column: str, n: float) -> float:
        return abs(n - guess) * (0.5 if column in text else 1.0)

    # The least and greatest gap that each column's sketch allows.
    open_: dict[str, tuple[float, float]] = {}
    for c, n in zip(others, seen["distinct"]):
        low, high = n / (1 + SKETCH_ERROR * SKETCH_MARGIN) - 1, n / (1 - SKETCH_ERROR * SKETCH_MARGIN) + 1
        if high > 1 and low < rows * 0.95:
            ends = gap(c, low), gap(c, high)
            sure = n < rows * 0.9 and n > 2  # surely no constant and no key of the rows
            open_[c] = (0.0 if low <= guess <= high else min(ends)), (max(ends) if sure else float("inf"))
    within = min((high for _, high in open_.values()), default=0.0)
    nearest = [c for c, (low, _) in open_.items() if low <= within]
    exact = {r["column_name"]: r["distinct_values"] for r in distinct_counts(df, nearest).collect()} if nearest else {}
    fit = [c for c in nearest if 1 < exact.get(c, 0) < rows * 0.95]
    best = min(fit, key=lambda c: (gap(c, exact[c]), c), default=None)
    found = [(months, exact[best], date, best, target)] if best else []
    schema = "months long, ids long, date_column string, id_column string, target_column string"
    return df.sparkSession.createDataFrame(found, schema)
