"""Running totals and exact percentiles over ordered values, without a
single-task window and without a per-column map of all distinct values."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tessella.operators.series import quoted
from tessella.session import materialize, shuffle_partitions


def n_ranges(df: DataFrame, least: int = 64) -> int:
    """Ordered ranges per group: a power of four (for the search below) that is
    no less than the shuffle partitions, so that every task gets its share."""
    n = least
    while n < shuffle_partitions(df):
        n *= 4
    return n


def _cut_points(value: Column | str, n: int) -> Column:
    """n - 1 approximate quantiles, from a mergeable sketch."""
    probs = F.array(*[F.lit(i / n) for i in range(1, n)])
    return F.percentile_approx(value, probs, F.lit(max(1000, 4 * n)))


def _find_range(df: DataFrame, value: str, n: int) -> DataFrame:
    """Replace ``_cuts`` by ``_range``, the number of cut points below the
    value: a four-way search that stays in generated code.  ``n`` is a power
    of four."""
    out = df.withColumn("_range", F.lit(0))
    step = n // 4
    while step:
        place = F.lit(0)
        for quarter in (1, 2, 3):
            cut = F.get("_cuts", F.col("_range") + (quarter * step - 1))
            place = F.when(cut < F.col(value), quarter * step).otherwise(place)
        out = out.withColumn("_range", F.col("_range") + place)
        step //= 4
    return out.drop("_cuts")


def ordered_totals(
    df: DataFrame,
    order: str,
    sums: list[str],
    groups: list[str] | None = None,
    descending: bool = True,
    listed_groups: bool = False,
) -> DataFrame:
    """Add ``run_<sum>`` (inclusive running sum) and ``all_<sum>`` (total).

    Input: one row per (groups, order value), i.e. already aggregated.  Each
    group is cut into ordered ranges at approximate quantiles of its distinct values;
    ranges are summed, offset and accumulated locally.  The cut points only
    balance the tasks: the result is exact wherever they fall.

    ``listed_groups`` says that the groups come from a list in the caller's
    code (columns, folds, budgets), so the two side tables, at most 64 rows or
    one array of 63 values per group, may be broadcast.  Other groups have no
    such bound and the optimizer chooses by size.
    """
    groups = list(groups or [])
    small = F.broadcast if listed_groups or not groups else (lambda side: side)
    n = n_ranges(df)
    cuts = _cut_points(order, n)
    if groups:
        with_cuts = df.join(small(df.groupBy(*groups).agg(cuts.alias("_cuts"))), groups)
    else:
        with_cuts = df.withColumn("_cuts", df.agg(cuts.alias("c")).scalar())
    ranged = _find_range(with_cuts, order, n)

    direction = F.desc if descending else F.asc
    per_range = ranged.groupBy(*groups, "_range").agg(
        *[F.sum(s).alias(f"_sum_{s}") for s in sums]
    )
    # At most n rows per group from here on.
    g = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    earlier = g.orderBy(direction("_range")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *groups,
        "_range",
        *[F.coalesce(F.sum(f"_sum_{s}").over(earlier), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(f"_sum_{s}").over(g).alias(f"all_{s}") for s in sums],
    )
    local = (
        Window.partitionBy(*groups, "_range")
        .orderBy(direction(order))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    running = ranged.withColumns({f"_run_{s}": F.sum(s).over(local) for s in sums})
    joined = running.join(small(offsets), [*groups, "_range"])
    out = joined.withColumns({f"run_{s}": F.col(f"_run_{s}") + F.col(f"_off_{s}") for s in sums})
    return out.drop("_range", *[f"_run_{s}" for s in sums], *[f"_off_{s}" for s in sums])


#: Bits by which the search for a percentile narrows down at a time.
DIGIT = 16
_LOW = 0x7FFF_FFFF_FFFF_FFFF


def _ordered_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Doubles as longs of the same order; nulls and NaN are null.  The first column stays."""
    for b in batches:
        out = [b.column(0)]
        for c in b.columns[1:]:
            x = c.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # one zero only
            bits = x.view(np.int64)
            out.append(pa.array(np.where(bits < 0, bits ^ _LOW, bits), pa.int64(), mask=np.isnan(x)))
        yield pa.RecordBatch.from_arrays(out, b.schema.names)


def _double(bits: int) -> float:
    return struct.unpack("<d", struct.pack("<q", bits ^ _LOW if bits < 0 else bits))[0]


def percentiles(df: DataFrame, cols: list[str], probs: list[float], part: Column | None = None) -> DataFrame:
    """Exact linear-interpolation percentiles: (column_name, prob, value).

    A radix selection for all columns and ranks at once, without sorting.  The
    columns are written once as longs that order like the doubles.  They are
    counted by their first 16 bits (map-side combine; 65,536 counts a column at
    most), and the values that share those bits with an asked rank are written and
    counted by the next 16, and so on, until all that is left of a
    rank is one value.  Running totals of the counts, in a task for each column and
    asked rank, find the count that holds a rank; the driver gets no other: one at most
    per column and asked rank, whatever the values.

    ``part`` numbers the rows of a short list of groups (folds, slices) from 0: each
    has its own percentiles, with its number in the column ``part``.
    """
    spark = df.sparkSession
    k = len(cols)
    number = F.lit(0) if part is None else part
    numeric = df.select(number.cast("long").alias("part"), *[quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    schema = ", ".join(["part long", *[f"c{i} long" for i in range(k)]])
    keys = materialize(numeric.mapInArrow(_ordered_bits, schema), "ordered-bits")
    places = [F.struct((F.col("part") * k + i).alias("at"), F.col(f"c{i}").alias("bits")) for i in range(k)]
    long = keys.select(F.inline(F.array(*places)))
    rows = long.filter(F.col("bits").isNotNull())

    def holding(values: DataFrame, shift: int, held: DataFrame | None = None) -> list[Row]:
        """The counts that hold an asked rank: column, prefix, first rank in it, its
        asked ranks, least and greatest value, all rows of the column."""
        prefix = F.shiftright("bits", shift) if shift else F.col("bits")
        counts = values.groupBy("at", prefix.alias("prefix")).agg(F.count("*").alias("n"), F.min("bits").alias("lo"), F.max("bits").alias("hi"))
        counts = counts.withColumn("within", F.lit(0).cast("long") if held is None else F.shiftright("prefix", DIGIT))
        each = Window.partitionBy("at", "within")  # 2 ** DIGIT rows at most
        earlier = each.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        if held is None:
            counts = counts.withColumn("total", F.sum("n").over(each))
            place = [(F.col("total") - 1) * F.lit(float(p)) for p in probs]
            ranks = F.array_distinct(F.array(*[f(h) for h in place for f in (F.floor, F.ceil)]).cast("array<long>"))
        else:
            same = (F.col("at") == F.col("held_at")) & (F.col("within") == F.col("held"))
            counts = counts.join(F.broadcast(held), same).withColumn("first", F.col("first") + F.col("held_first"))  # one row per column and asked rank at most
            counts, ranks = counts.withColumn("total", F.lit(0).cast("long")), F.col("held_ranks")
        inside = F.filter(ranks, lambda k: (k >= F.col("first")) & (k < F.col("first") + F.col("n")))
        return counts.withColumn("ranks", inside).filter(F.size("ranks") > 0).select("at", "prefix", "first", "ranks", "lo", "hi", "total").collect()

    found: dict[tuple[int, int], int] = {}  # (column, rank) to its bits
    shift = 64 - DIGIT
    counts = holding(rows, shift)
    total = dict(sorted((r["at"], r["total"]) for r in counts))
    while True:
        found |= {(r["at"], k): r["lo"] for r in counts if r["lo"] == r["hi"] for k in r["ranks"]}
        asked = [(r["at"], r["prefix"], r["first"], r["ranks"]) for r in counts if r["lo"] < r["hi"]]
        if not asked:
            break
        held = spark.createDataFrame(asked, "held_at long, held long, held_first long, held_ranks array<long>")
        same = (F.col("at") == F.col("held_at")) & (F.shiftright("bits", shift) == F.col("held"))
        rows = rows.join(F.broadcast(held), same, "left_semi")  # one row per column and asked rank at most
        if shift == 64 - DIGIT:
            rows = materialize(rows, "percentile-values")
        shift -= DIGIT
        counts = holding(rows, shift, held)

    out = []
    for at, n in total.items():
        for p in probs:
            h = (n - 1) * p
            lo, hi = (_double(found[at, k]) for k in (math.floor(h), math.ceil(h)))
            out.append((at // k, cols[at % k], float(p), lo if lo == hi else lo + (hi - lo) * (h - math.floor(h))))
    found_rows = spark.createDataFrame(out, "part long, column_name string, prob double, value double")
    return found_rows.drop("part") if part is None else found_rows


def percentile_map(df: DataFrame, cols: list[str], probs: list[float]) -> Column:
    """Scalar map: column -> array of its percentiles in the order asked.

    Bounded by columns x probabilities.
    """
    rows = percentiles(df, cols, probs)
    per_col = rows.groupBy("column_name").agg(
        F.array_sort(F.collect_list(F.struct("prob", "value"))).alias("pv")
    )
    ordered = F.transform("pv", lambda x: x["value"])
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("column_name"), ordered)))
    return per_col.agg(entries.alias("m")).scalar()
