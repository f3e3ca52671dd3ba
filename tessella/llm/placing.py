"""Places of rows within ordered groups, however large a group is.

A window over a group would sort it in one task.  Here rows are dealt to ranges
of (group, order), so a hot group spans many tasks; rows are numbered within
their range, and the ranges of a group, no more than there are shuffle
partitions, add up to offsets.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import materialize, shuffle_partitions


def place(df: DataFrame, group: list[str], order: list[str], totals: tuple[str, ...] = (), idx: str = "idx", size: str = "size") -> DataFrame:
    """``df`` with ``idx`` (from 0, within the group by ``order``) and ``size`` of
    the group, named as asked; for each column of ``totals`` also ``<name>_before``, its sum over
    the group's earlier rows.

    Null groups are a group; nulls come first.  Rows that tie in ``order`` get
    different places.  ``df`` must not have the columns named here.
    """
    ranged = (
        df.withColumn("dealt", F.spark_partition_id())  # equal rows are told apart by where they were read
        .repartitionByRange(shuffle_partitions(df), *group, *order, "dealt")
        .sortWithinPartitions(*group, *order, "dealt")
        .withColumn("seq", F.monotonically_increasing_id())
        .drop("dealt")
    )
    rows = materialize(ranged, "placed").withColumn("part", F.shiftright("seq", 33))
    within = Window.partitionBy("part", *group).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    for c in totals:
        rows = rows.withColumn(f"{c}_before", F.coalesce(F.sum(c).over(within), F.lit(0)))
    ranges = rows.groupBy("part", *group).agg(
        F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"{c}_sum") for c in totals]
    )
    whole, earlier = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        F.col("part").alias("part_"),
        *[F.col(g).alias(f"{g}_") for g in group],
        "first",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"),
        F.sum("n").over(whole).alias(size),
        *[F.coalesce(F.sum(f"{c}_sum").over(earlier), F.lit(0)).alias(f"{c}_base") for c in totals],
    )
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"{g}_")) for g in group], F.col("part") == F.col("part_"))
    return rows.join(ranges, same).select(
        *df.columns,
        (F.col("base") + F.col("seq") - F.col("first")).alias(idx),
        size,
        *[(F.col(f"{c}_base") + F.col(f"{c}_before")).alias(f"{c}_before") for c in totals],
    )
