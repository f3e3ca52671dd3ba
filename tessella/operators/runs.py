"""Statistics of a run: what each stage read, wrote and noticed, and how long it took."""

from __future__ import annotations

import time
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessella.operators.series import quoted
from tessella.session import materialize

STAGE = "stage string, files long, n_rows long, entities long, warnings long, errors long, seconds double"


@dataclass
class Stage:
    stage: str
    files: int
    n_rows: int
    entities: int
    warnings: int
    errors: int
    seconds: float


class Run:
    """Collects the statistics of its stages; ``report`` has one row per stage."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.stages = spark, []

    def stage(self, name: str, df: DataFrame, entity: str, warnings: Column, errors: Column) -> DataFrame:
        """Write ``df`` and go on with what was written.

        Rows, warnings and errors (rows where the conditions hold) are observed while
        it is written, without another pass; files are those its plan reads;
        entities are counted in what was written, one column of it.
        """
        start = time.perf_counter()
        seen = Observation(name)
        watched = df.observe(
            seen,
            F.count(F.lit(1)).alias("n_rows"),
            F.count(F.when(warnings, 1)).alias("warnings"),
            F.count(F.when(errors, 1)).alias("errors"),
        )
        out = materialize(watched, f"stage-{name}")
        entities = out.select(quoted(entity)).distinct().count()
        got = seen.get
        self.stages.append(
            Stage(name, len(df.inputFiles()), got["n_rows"], entities, got["warnings"], got["errors"], time.perf_counter() - start)
        )
        return out

    def report(self) -> DataFrame:
        return self.spark.createDataFrame([astuple(s) for s in self.stages], STAGE)
