"""Session helpers: builder, shared work folder, one-row statistics."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "tessella", cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        # sessions of a busy entity are merged in the map tasks before the shuffle
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local: dict[str, tempfile.TemporaryDirectory] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    The setting is required on a cluster, where a machine-local folder would
    lose data with its executor.  A local session without it gets one folder
    that goes when the process ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = tempfile.TemporaryDirectory(prefix="tessella-", ignore_cleanup_errors=True)
        named = _local[app].name
    return named.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; never reused, so never overwritten."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application has written below the shared folder.

    For the owner of the session, once no result is read any more.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by writing to the shared folder and reading back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(df: DataFrame) -> int:
    """The session's shuffle partitions: the measure for how far to split work."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def split_by(df: DataFrame, n_rows: int, *keys: str, task_rows: int = 1_500_000) -> DataFrame:
    """Rows dealt to tasks by a hash of ``keys``, as many tasks as hold about
    ``task_rows`` of ``n_rows`` each: what a task sorts or counts does not grow with the table."""
    return df.repartition(max(shuffle_partitions(df), -(-n_rows // task_rows)), *keys)


def one_row(df: DataFrame, **aggregates: Column) -> Column:
    """Global statistics as a scalar-subquery struct.

    The aggregate is computed once with partial sums and inlined as a value, so
    applying it needs neither a join nor an unpartitioned window.
    """
    fields = [expr.alias(name) for name, expr in aggregates.items()]
    return df.agg(F.struct(*fields).alias("stats")).scalar()


def bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Carry a scalar value as a column, so that a projection which uses it
    many times plans its subquery once."""
    return df.withColumn(name, value)


def freeze(df: DataFrame, value: Column) -> Column:
    """Evaluate a scalar struct or map now and return it as a literal.

    For model fits, which read their input many times: fitted statistics (one
    number or two per feature) are computed once.
    """
    got = df.sparkSession.range(1).select(value.alias("v")).first()["v"]
    if isinstance(got, dict):
        if not got:  # an empty map literal has no type
            return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<double>>"))
        pairs = [x for k, v in got.items() for x in (F.lit(k), F.array(*[F.lit(float(i)) for i in v]))]
        return F.create_map(*pairs)
    return F.struct(*[F.lit(v).cast("double").alias(k) for k, v in got.asDict().items()])
