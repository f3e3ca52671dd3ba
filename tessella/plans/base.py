"""Registry of queries on the driver tables and the relations they share.

Each query sits beside the SQL that must give the same rows.  Money sums are
rounded to the precision of their inputs in both, so that later steps start
from identical numbers; derived numbers are rounded once at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its oracle."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(col: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column once, at the end of a query."""
    new = {c: F.round(F.col(f"`{c}`"), digits) for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(new) if new else df


# ----------------------------------------------------------- shared relations


def customer_months(spark: SparkSession, d: str) -> DataFrame:
    """Orders per customer and month (sparse: customers come and go)."""
    o = table(spark, d, "orders")
    return o.groupBy(
        F.col("o_custkey").alias("entity"), F.trunc("o_orderdate", "month").alias("period")
    ).agg(
        F.count("*").alias("n_orders"),
        F.round(F.sum("o_totalprice"), 2).alias("amount"),
        F.round(F.max("o_totalprice"), 2).alias("largest"),
    )


CUSTOMER_MONTHS = """customer_months AS (
  SELECT o_custkey AS entity, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
         count(*) AS n_orders, round(sum(o_totalprice), 2) AS amount,
         round(max(o_totalprice), 2) AS largest
  FROM orders GROUP BY 1, 2)"""


def moved(orders: DataFrame, months: list[int]) -> DataFrame:
    """Orders with those of some calendar months dated one month later: real
    gaps in the calendar with every row still there."""
    day = F.col("o_orderdate").cast("date")
    return orders.withColumn("o_orderdate", F.when(F.month(day).isin(months), F.add_months(day, 1)).otherwise(day))


def moved_sql(months: str) -> str:
    return (
        f"SELECT * REPLACE (CAST(CASE WHEN month(o_orderdate) IN ({months}) THEN o_orderdate + INTERVAL 1 MONTH "
        "ELSE o_orderdate END AS DATE) AS o_orderdate) FROM orders"
    )


def supplier_months(spark: SparkSession, d: str) -> DataFrame:
    """Lineitem measures per supplier and month (dense)."""
    li = table(spark, d, "lineitem")
    price = F.col("l_extendedprice")
    return li.groupBy(
        F.col("l_suppkey").alias("entity"), F.trunc("l_shipdate", "month").alias("period")
    ).agg(
        F.round(F.sum("l_quantity"), 2).alias("quantity"),
        F.round(F.sum(price), 2).alias("price"),
        F.round(F.sum(price * F.col("l_discount")), 4).alias("discount"),
        F.round(F.sum(price * F.col("l_tax")), 4).alias("tax"),
        F.round(F.sum(F.when(F.col("l_returnflag") == "R", price)), 2).alias("returned"),
    )


SUPPLIER_MONTHS = """supplier_months AS (
  SELECT l_suppkey AS entity, CAST(date_trunc('month', l_shipdate) AS DATE) AS period,
         round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS price,
         round(sum(l_extendedprice * l_discount), 4) AS discount,
         round(sum(l_extendedprice * l_tax), 4) AS tax,
         round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END), 2) AS returned
  FROM lineitem GROUP BY 1, 2)"""


def customer_panel(spark: SparkSession, d: str, lagged: tuple[str, ...] = ()) -> DataFrame:
    """Rectangular customer x month panel with failure flags."""
    from tessella.operators.panel import build_panel

    return build_panel({"orders": customer_months(spark, d)}, "entity", "period", min_gap=6, lagged=lagged)


CUSTOMER_PANEL = (
    CUSTOMER_MONTHS
    + """,
bounds AS (SELECT min(period) AS lo, max(period) AS hi FROM customer_months),
cal AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS period FROM bounds),
ents AS (SELECT DISTINCT entity FROM customer_months),
grid AS (SELECT e.entity, c.period FROM ents e, cal c),
joined AS (
  SELECT g.entity, g.period, m.n_orders, m.amount, m.largest,
         CASE WHEN m.entity IS NULL THEN 0 ELSE 1 END AS present
  FROM grid g LEFT JOIN customer_months m ON m.entity = g.entity AND m.period = g.period),
lasts AS (SELECT entity, max(period) FILTER (WHERE present = 1) AS last_reporting_date FROM joined GROUP BY 1),
deaths AS (
  SELECT l.entity, l.last_reporting_date,
         CASE WHEN (SELECT count(*) FROM cal WHERE cal.period > l.last_reporting_date) >= 6
              THEN CAST(l.last_reporting_date + INTERVAL 1 MONTH AS DATE) END AS failure_date
  FROM lasts l),
panel AS (
  SELECT j.*, d.last_reporting_date, d.failure_date,
         CAST(coalesce(j.period >= d.failure_date, FALSE) AS INTEGER) AS failed
  FROM joined j JOIN deaths d USING (entity))"""
)


def scored_documents(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents with a score in [0, 1] derived from their length.

    A language stands for the reporting period of the ranking operators.
    """
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source")
    lab = table(spark, d, "labels")
    return lab.join(docs, "doc_id").select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        "quality",
        "toxic",
        F.round(F.col("n_chars") / (F.col("n_chars") + 2000.0), 4).alias("p"),
    )


SCORED = """scored AS (
  SELECT l.doc_id, lang, source, n_chars, quality, toxic,
         round(n_chars / (n_chars + 2000.0), 4) AS p
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""
