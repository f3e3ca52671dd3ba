"""File scans, discovery and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None,
    dates: dict[str, str] | None = None, missing: str = "",
) -> DataFrame:
    """Delimited text with a declared schema, or all strings without one.

    A byte-order mark in the header is tolerated; ``dates`` maps columns to
    their text format; unparsable dates become null; NaN becomes null.
    """
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("nullValue", missing)
    if schema is not None:
        df = reader.schema(schema).option("enforceSchema", True).csv(path)
    else:
        df = reader.option("inferSchema", False).csv(path)
        df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    for c, fmt in (dates or {}).items():
        df = df.withColumn(c, F.try_to_timestamp(F.col(c).cast("string"), F.lit(fmt)).cast("date"))
    doubles = {c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(doubles) if doubles else df


def discover(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """Files of a folder by name, without editors' lock files; contents are
    not read because only metadata columns are selected."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("path", "modificationTime", "length")
    )
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("file", name).filter(~F.col("file").startswith("~$"))


def latest(files: DataFrame, column: str = "file") -> DataFrame:
    """The file whose name sorts last."""
    newest = files.agg(F.max(column).alias("m")).scalar()
    return files.filter(F.col(column) == newest)


def save_csv(df: DataFrame, folder: str, snapshot: str, compress: bool = True) -> str:
    """Write one snapshot folder; earlier snapshots stay as backups."""
    path = f"{folder}/snapshot_ts={snapshot}"
    writer = df.write.option("header", True)
    if compress:
        writer = writer.option("compression", "gzip")
    writer.csv(path)
    return path


def save_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    df.write.partitionBy(*(partition_by or [])).parquet(path)
    return path


def save_json(df: DataFrame, path: str) -> str:
    """A manifest: a few rows of nested values as JSON lines."""
    df.write.json(path)
    return path


def save_stage(df: DataFrame, folder: str, stage: str) -> DataFrame:
    """Write a stage's result and continue from the written table."""
    path = f"{folder}/{stage}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def truncate_before(df: DataFrame, date_col: str, cutoff: str) -> DataFrame:
    """Rows on or after the cutoff; the filter reaches the file scan."""
    return df.filter(F.col(date_col) >= F.lit(cutoff).cast("date"))


def rewrite_truncated(
    spark: SparkSession, manifest: dict[str, str], out: str, date_col: str, cutoff: str
) -> DataFrame:
    """Truncate every table of a manifest into a new folder and report counts."""
    reports = []
    for name, path in manifest.items():
        table = spark.read.parquet(path)
        kept = truncate_before(table, date_col, cutoff)
        kept.write.parquet(f"{out}/{name}")
        ok = F.col(date_col) >= F.lit(cutoff).cast("date")
        reports.append(
            table.agg(
                F.lit(name).alias("table_name"),
                F.count("*").alias("rows_before"),
                F.count(F.when(ok, 1)).alias("rows_after"),
            )
        )
    report = reports[0]
    for r in reports[1:]:
        report = report.unionByName(r)
    return report.withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))
