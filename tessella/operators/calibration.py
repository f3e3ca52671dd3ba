"""Monotone calibration kept as a table of steps.

Pooling adjacent violators merges: what is pooled within a range of scores stays
pooled in the whole.  So scores are counted, every range is pooled in its own
task, and one more task pools the blocks that are left.  The steps are saved and
applied by looking a score up between its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.numeric import clip
from tessella.operators.series import quoted
from tessella.session import shuffle_partitions

BLOCK = "lo double, hi double, n long, positives long"
#: A table of more steps (two doubles each) is refused rather than sent to tasks.
MAX_STEPS = 1_000_000


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adjacent blocks of rising score, pooled until their rates rise too."""
    stack: list[list] = []
    for b in batches:
        for lo, hi, n, positives in zip(*[b.column(c).to_pylist() for c in ("lo", "hi", "n", "positives")]):
            block = [lo, hi, n, positives]
            while stack and stack[-1][3] * block[2] >= block[3] * stack[-1][2]:
                first = stack.pop()
                block = [first[0], block[1], first[2] + block[2], first[3] + block[3]]
            stack.append(block)
    columns = list(zip(*stack)) or [()] * 4
    types = (pa.float64(), pa.float64(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["lo", "hi", "n", "positives"])


def fit_steps(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, value): the monotone rate of ``label`` at both ends of every block.

    Scores are clipped to [0, 1]; null scores and labels do not count.
    """
    rows = df.select(clip(quoted(score), 0.0, 1.0).alias("lo"), F.col(label).cast("long").alias("y")).na.drop()
    counted = rows.groupBy("lo").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))
    counted = counted.select("lo", F.col("lo").alias("hi"), "n", "positives")
    ranged = counted.repartitionByRange(shuffle_partitions(df), "lo").sortWithinPartitions("lo").mapInArrow(_pooled, BLOCK)
    blocks = ranged.repartition(1).sortWithinPartitions("lo").mapInArrow(_pooled, BLOCK)  # blocks that rise within ranges
    ends = F.when(F.col("lo") < F.col("hi"), F.array("lo", "hi")).otherwise(F.array("lo"))
    return blocks.select(F.explode(ends).alias("score"), (F.col("positives") / F.col("n")).alias("value"))


def apply_steps(df: DataFrame, steps: DataFrame, score: str, out: str = "calibrated") -> DataFrame:
    """``out``: the value between a score's neighbouring steps, the outermost value
    beyond them; null for a null score or without steps."""
    rows = steps.limit(MAX_STEPS + 1).collect()
    if len(rows) > MAX_STEPS:
        raise ValueError(f"more than {MAX_STEPS} steps")
    table = np.array(sorted((r["score"], r["value"]) for r in rows)).reshape(-1, 2)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(score).cast(pa.float64()).to_numpy(zero_copy_only=False)
            none = np.isnan(x) | (len(table) == 0)
            value = np.interp(np.clip(x, 0, 1), table[:, 0], table[:, 1]) if len(table) else np.zeros(len(x))
            column = pa.array(value, pa.float64(), mask=none)
            yield pa.RecordBatch.from_arrays([*b.columns, column], [*b.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(looked_up, f"{schema}, `{out}` double")
