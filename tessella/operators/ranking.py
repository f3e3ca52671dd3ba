"""Top-k reports and alert budgets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.quantiles import ordered_totals
from tessella.session import one_row, shuffle_partitions


def top_k(df: DataFrame, k: int, order: list) -> DataFrame:
    """Global top k; every task keeps k rows before the merge."""
    return df.orderBy(*order).limit(k)


def rank_in_group(df: DataFrame, keys: list[str], order: list, k: int, out: str = "rank") -> DataFrame:
    """Rows ranked 1..k per group, by one plan for every k.

    A first ranking within hash parts of each group keeps k rows per part, so
    the final task of a hot group sees at most ``parts * k`` rows, however many
    map tasks there are.  The parts follow the shuffle partitions.
    """
    final = Window.partitionBy(*keys).orderBy(*order)
    parts = max(2, math.isqrt(shuffle_partitions(df)))
    near = Window.partitionBy(*keys, "_part").orderBy(*order)
    df = (
        df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(parts)))
        .withColumn("_near", F.row_number().over(near))
        .filter(F.col("_near") <= k)
        .drop("_near", "_part")
    )
    return df.withColumn(out, F.row_number().over(final)).filter(F.col(out) <= k)


def watch_list(df: DataFrame, period: str, order: list, k: int) -> DataFrame:
    """Top k rows of the latest period."""
    latest = one_row(df, m=F.max(period))["m"]
    return top_k(df.filter(F.col(period) == latest), k, order)


def topk_capture(
    df: DataFrame, period: str, label: str, score: str, tie: str, ks: list[int]
) -> DataFrame:
    """Alerts, captured and positives per period and k; ranks are computed once."""
    positives = df.groupBy(period).agg(F.sum(label).cast("long").alias("positives"))
    ranked = rank_in_group(df, [period], [F.desc(score), F.asc(tie)], max(ks))
    per_k = F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: F.col("rank") <= k))
    hits = (
        ranked.withColumn("k", per_k)
        .groupBy(period, "k")
        .agg(F.count("*").alias("alerts"), F.sum(label).cast("long").alias("captured"))
    )
    return hits.join(positives, period)


def topk_capture_overall(per_period: DataFrame) -> DataFrame:
    totals = per_period.groupBy("k").agg(
        F.sum("alerts").alias("alerts"),
        F.sum("captured").alias("captured"),
        F.sum("positives").alias("positives"),
    )
    return totals.withColumns(
        {
            "precision": F.coalesce(F.try_divide("captured", "alerts"), F.lit(0.0)),
            "recall": F.coalesce(F.try_divide("captured", "positives"), F.lit(0.0)),
        }
    )


def top_percent(
    df: DataFrame, percents: list[float], score: str, label: str, tie: str
) -> DataFrame:
    """Rows, precision and recall in the top n percent by score.

    k is rounded half-even and at least 1.  Scores are counted first; rows
    inside the one score group that straddles k are ordered by ``tie``.
    """
    per_score = df.groupBy(score).agg(
        F.count("*").alias("n"), F.sum(label).cast("long").alias("tp")
    )
    placed = ordered_totals(per_score, score, ["n", "tp"])
    asked = F.explode(F.array(*[F.lit(p) for p in percents]))
    k = F.greatest(F.lit(1), F.bround(F.col("percent") * F.col("all_n")).cast("long"))
    cut = (
        placed.withColumn("percent", asked)
        .withColumn("k", k)
        .withColumn("start", F.col("run_n") - F.col("n"))
        .filter((F.col("start") < F.col("k")) & (F.col("run_n") >= F.col("k")))
        .withColumn("need", F.col("k") - F.col("start"))
        .withColumn("tp_above", F.col("run_tp") - F.col("tp"))
        .select(F.col(score).alias("_cut"), "percent", "k", "need", "tp_above", "all_tp")
    )
    # One row per percent; only rows with exactly that score take part.
    edge = df.join(F.broadcast(cut), df[score] == F.col("_cut")).select(
        "percent", F.col(label).alias("_y"), F.col(tie).alias("_tie"), "need"
    )
    # Split the straddling score group by its tie key the same way, exactly.
    per_tie = edge.groupBy("percent", "_tie").agg(
        F.count("*").alias("m"), F.sum("_y").cast("long").alias("t"), F.max("need").alias("need")
    )
    inside = (
        ordered_totals(per_tie, "_tie", ["m"], ["percent"], descending=False, listed_groups=True)
        .filter(F.col("run_m") <= F.col("need"))
        .groupBy("percent")
        .agg(F.sum("t").alias("tp_edge"))
    )
    out = cut.join(inside, "percent", "left")
    hits = F.col("tp_above") + F.coalesce("tp_edge", F.lit(0))
    return out.select(
        "percent",
        "k",
        (hits / F.col("k")).alias("precision"),
        F.try_divide(hits, F.col("all_tp")).alias("recall"),
    )


def top_percent_rows(df: DataFrame, percent: float, score: str, tie: str) -> DataFrame:
    """The rows of the top n percent by score (ties by ``tie``, which is unique)."""
    per_score = df.groupBy(score).agg(F.count("*").alias("n"))
    placed = ordered_totals(per_score, score, ["n"])
    k = F.greatest(F.lit(1), F.bround(F.lit(percent) * F.col("all_n")).cast("long"))
    start = F.col("run_n") - F.col("n")
    edge = placed.filter((start < k) & (F.col("run_n") >= k)).select(
        F.col(score).alias("cut"), (k - start).alias("need")
    )
    at = edge.agg(F.struct(F.max("cut").alias("cut"), F.max("need").alias("need")).alias("s")).scalar()
    above = df.filter(F.col(score) > at["cut"])
    tied = df.filter(F.col(score) == at["cut"])
    counted = ordered_totals(
        tied.select(F.col(tie).alias("_tie"), F.lit(1).alias("m")), "_tie", ["m"], descending=False
    )
    last = counted.filter(F.col("run_m") <= at["need"]).agg(F.max("_tie").alias("t")).scalar()
    return above.unionByName(tied.filter(F.col(tie) <= last))
