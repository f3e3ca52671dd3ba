"""Profile, distribution and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import quality as QA
from tessella.plans.base import (
    CUSTOMER_MONTHS,
    CUSTOMER_PANEL,
    SCORED,
    SUPPLIER_MONTHS,
    customer_months,
    customer_panel,
    query,
    r,
    rounded,
    scored_documents,
    supplier_months,
    table,
)

COLS = ["quantity", "price", "returned"]


def _each(sql: str, cols=COLS) -> str:
    return " UNION ALL ".join(sql.replace("{c}", c) for c in cols)


@query(
    "missing_rates",
    f"""WITH {SUPPLIER_MONTHS} {_each("SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, round((1 - count({c}) / count(*)) * 100, 6) AS missing_pct FROM supplier_months")}""",
)
def missing_rates(spark, d):
    """E9 per column."""
    return rounded(QA.missing_rates(supplier_months(spark, d), COLS))


@query(
    "overall_missing_rate",
    f"""WITH {CUSTOMER_PANEL} SELECT round((2 * count(*) - count(amount) - count(largest)) / (2 * count(*)) * 100, 6) AS missing_pct FROM panel""",
)
def overall_missing_rate(spark, d):
    """E9 overall."""
    return rounded(QA.overall_missing_rate(customer_panel(spark, d), ["amount", "largest"]))


PROBS = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
DESCRIBE = (
    "SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
    "round(min({c}), 4) AS min, round(max({c}), 4) AS max, count(*) - count({c}) AS missing, "
    "round((1 - count({c}) / count(*)) * 100, 4) AS missing_pct, "
    + ", ".join(f"round(quantile_cont({{c}}, {p}), 4) AS {n}" for n, p in PROBS.items())
    + " FROM supplier_months"
)


@query("describe_measures", f"WITH {SUPPLIER_MONTHS} {_each(DESCRIBE)}")
def describe_measures(spark, d):
    """E10."""
    return rounded(QA.describe(supplier_months(spark, d), COLS), 4)


@query("class_balance", f"WITH {SCORED} SELECT toxic, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM scored), 6) AS pct FROM scored GROUP BY 1")
def class_balance(spark, d):
    """E13."""
    return rounded(QA.class_balance(scored_documents(spark, d), "toxic"))


@query(
    "cross_sectional_dispersion",
    f"""WITH {SUPPLIER_MONTHS}, s AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in COLS)} FROM supplier_months),
p AS (SELECT period, {", ".join(f"stddev_pop(({c} - m_{c}) / s_{c}) AS {c}" for c in COLS)} FROM supplier_months, s GROUP BY 1),
u AS ({_each("SELECT '{c}' AS column_name, avg({c}) AS dispersion FROM p")})
SELECT column_name, round(dispersion, 6) AS dispersion, CAST(row_number() OVER (ORDER BY dispersion DESC, column_name) AS INTEGER) AS rank FROM u""",
)
def cross_sectional_dispersion(spark, d):
    """E16."""
    return rounded(QA.dispersion(supplier_months(spark, d), "period", COLS))


@query(
    "correlation_matrix",
    f"""WITH {SUPPLIER_MONTHS} """
    + " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS corr FROM supplier_months" for a in COLS for b in COLS
    ),
)
def correlation_matrix(spark, d):
    """E17."""
    return rounded(QA.correlation_matrix(supplier_months(spark, d), COLS))


@query(
    "between_entity_share",
    f"""WITH {SUPPLIER_MONTHS} {_each('''SELECT '{c}' AS column_name, round((SELECT sum(n * (m - g) * (m - g)) / sum(n) FROM (SELECT count({c}) AS n, avg({c}) AS m,
  (SELECT avg({c}) FROM supplier_months) AS g FROM supplier_months GROUP BY entity HAVING count({c}) > 0)) / var_pop({c}), 6) AS between_share FROM supplier_months''')}""",
)
def between_entity_share(spark, d):
    """E18."""
    return rounded(QA.between_share(supplier_months(spark, d), "entity", COLS))


@query(
    "distinct_counts",
    """SELECT 'o_custkey' AS column_name, count(DISTINCT o_custkey) AS distinct_values FROM orders UNION ALL
SELECT 'o_orderdate', count(DISTINCT o_orderdate) FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders""",
)
def distinct_counts(spark, d):
    """E21."""
    return QA.distinct_counts(table(spark, d, "orders"), ["o_custkey", "o_orderdate", "o_orderpriority"])


@query(
    "trend_lines",
    """SELECT o_orderpriority, round(regr_slope(o_totalprice, CAST(o_orderkey AS DOUBLE)), 6) AS slope,
  round(regr_intercept(o_totalprice, CAST(o_orderkey AS DOUBLE)), 3) AS intercept FROM orders GROUP BY 1""",
)
def trend_lines(spark, d):
    """E23."""
    o = table(spark, d, "orders").withColumn("x", F.col("o_orderkey").cast("double"))
    out = QA.trend_line(o, ["o_orderpriority"], "x", "o_totalprice")
    return out.withColumns({"slope": r("slope"), "intercept": r("intercept", 3)})


@query(
    "period_means",
    """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, round(avg(o_totalprice), 6) AS mean_o_totalprice,
  CAST(min(year(o_orderdate)) AS INTEGER) AS year FROM orders GROUP BY 1""",
)
def period_means(spark, d):
    """E24."""
    o = table(spark, d, "orders").withColumns({"period": F.trunc("o_orderdate", "month"), "year": F.year("o_orderdate")})
    return rounded(QA.period_mean(o, "period", "o_totalprice", "year"))


@query(
    "required_columns",
    "SELECT count(*) AS table_rows, c.column_name, c.found FROM orders, (VALUES ('o_custkey', TRUE), ('o_orderdate', TRUE), ('bank_name', FALSE)) c(column_name, found) GROUP BY 2, 3",
)
def required_columns(spark, d):
    """L1."""
    return QA.required_columns(table(spark, d, "orders"), ["o_custkey", "o_orderdate", "bank_name"])


@query(
    "null_keys_and_rates",
    f"""WITH {CUSTOMER_PANEL}, x AS (SELECT CASE WHEN entity % 50 = 0 THEN NULL ELSE entity END AS entity, period, amount FROM panel)
SELECT 'entity' AS column_name, count(*) - count(entity) AS nulls, round(1 - count(entity) / count(*), 6) AS null_share, 'null_key' AS issue FROM x
UNION ALL SELECT 'period', count(*) - count(period), round(1 - count(period) / count(*), 6), 'ok' FROM x
UNION ALL SELECT 'amount', count(*) - count(amount), round(1 - count(amount) / count(*), 6), CASE WHEN 1 - count(amount) / count(*) > 0.5 THEN 'mostly_null' ELSE 'ok' END FROM x""",
)
def null_keys_and_rates(spark, d):
    """L2."""
    p = customer_panel(spark, d).select(F.when(F.col("entity") % 50 != 0, F.col("entity")).alias("entity"), "period", "amount")
    return rounded(QA.null_key_check(p, ["entity", "period"], ["amount"]))


@query(
    "entity_count_check",
    """SELECT count(DISTINCT l_suppkey) AS entities, CASE WHEN count(DISTINCT l_suppkey) < 10 THEN 'low' ELSE 'good' END AS diversity,
  CASE WHEN count(DISTINCT l_suppkey) > 70 THEN 'above' WHEN count(DISTINCT l_suppkey) < 60 THEN 'below' ELSE 'in_range' END AS range_status FROM lineitem""",
)
def entity_count_check(spark, d):
    """L3."""
    return QA.entity_count_check(table(spark, d, "lineitem"), "l_suppkey", 10, 60, 70)


@query("date_validity", "SELECT count(*) AS table_rows, count(*) FILTER (WHERE o_orderkey % 11 = 0) AS invalid_dates FROM orders")
def date_validity(spark, d):
    """L4."""
    o = table(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 11 == 0, "2020-13-45").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return QA.date_validity(o.select(text.alias("day")), "day")


@query(
    "availability_bands",
    f"""WITH {CUSTOMER_PANEL} SELECT entity, round(avg(present), 6) AS availability,
  CASE WHEN avg(present) < 0.1 THEN 'critical' WHEN avg(present) < 0.3 THEN 'warning' ELSE 'acceptable' END AS band FROM panel GROUP BY 1""",
)
def availability_bands(spark, d):
    """L5 per entity."""
    return rounded(QA.availability_band(customer_panel(spark, d), ["entity"], "present"))


@query(
    "duplicate_keys",
    """SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1""",
)
def duplicate_keys(spark, d):
    """L6."""
    o = table(spark, d, "orders").select("o_custkey", F.trunc("o_orderdate", "month").alias("period"))
    return QA.duplicate_keys(o, ["o_custkey", "period"])


@query(
    "batch_statistics",
    """WITH t AS (SELECT event_type, count(*) AS n_rows, count(*) FILTER (WHERE value < 5) AS empty_rows FROM events GROUP BY 1)
SELECT event_type, n_rows, empty_rows, round((SELECT avg(n_rows) FROM t), 6) AS average_rows FROM t""",
)
def batch_statistics(spark, d):
    """L8."""
    return rounded(QA.batch_statistics(table(spark, d, "events"), "event_type", F.col("value") < 5))


@query(
    "schema_drift",
    """WITH s AS (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS snapshot, CASE l_returnflag WHEN 'A' THEN 'assets_' WHEN 'N' THEN 'equity_' ELSE '' END
    || 'Item ' || l_linenumber || CASE WHEN l_linestatus = 'O' THEN '' ELSE ' ' END AS raw FROM lineitem),
n AS (SELECT snapshot, raw, lower(replace(trim(raw), ' ', '_')) AS norm FROM s),
g AS (SELECT snapshot, CASE WHEN norm LIKE 'assets_%' THEN 'assets' WHEN norm LIKE 'equity_%' THEN 'equity' ELSE 'other' END AS column_class, norm, count(*) AS n FROM n GROUP BY ALL)
SELECT snapshot, column_class, CAST(sum(n) AS BIGINT) AS columns, CAST(sum(n - 1) AS BIGINT) AS twins FROM g GROUP BY 1, 2""",
)
def schema_drift(spark, d):
    """Column names per yearly snapshot; look-alike and spacing twins."""
    li = table(spark, d, "lineitem")
    prefix = F.when(F.col("l_returnflag") == "A", "assets_").when(F.col("l_returnflag") == "N", "equity_").otherwise("")
    look_alike = F.when(F.col("l_linestatus") == "O", "Item ").otherwise("Itеm ")  # Cyrillic e
    names = li.select(
        F.year("l_shipdate").alias("snapshot"), F.concat(prefix, look_alike, F.col("l_linenumber").cast("string")).alias("col_name")
    ).distinct()
    return QA.schema_drift(names, "snapshot", "col_name")


@query(
    "event_preservation",
    f"""WITH {CUSTOMER_PANEL} SELECT CAST(sum(failed) AS BIGINT) AS events_before, CAST(sum(failed) FILTER (WHERE period >= DATE '1997-01-01') AS BIGINT) AS events_after,
  sum(failed) = sum(failed) FILTER (WHERE period >= DATE '1997-01-01') AS preserved FROM panel""",
)
def event_preservation(spark, d):
    """L11."""
    p = customer_panel(spark, d)
    return QA.event_preservation(p, p.filter("period >= DATE'1997-01-01'"), "failed")


@query(
    "cutoff_reconciliation",
    """SELECT count(*) AS rows_before, count(*) FILTER (WHERE o_orderdate >= DATE '1997-01-01') AS rows_after,
  count(*) - count(*) FILTER (WHERE o_orderdate >= DATE '1997-01-01') AS rows_removed FROM orders""",
)
def cutoff_reconciliation(spark, d):
    """L12."""
    return QA.cutoff_reconciliation(table(spark, d, "orders"), "o_orderdate", "1997-01-01")


@query(
    "joined_series_coverage",
    f"""WITH {CUSTOMER_MONTHS}, m AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period, max(l_tax) AS tax, max(CASE WHEN l_tax > 0.07 AND month(l_shipdate) < 9 THEN l_tax END) AS high
  FROM lineitem GROUP BY 1), j AS (SELECT tax, high FROM customer_months LEFT JOIN m USING (period))
SELECT 'tax' AS column_name, round(count(tax) / count(*), 6) AS coverage, count(tax) / count(*) >= 0.75 AS sufficient FROM j
UNION ALL SELECT 'high', round(count(high) / count(*), 6), count(high) / count(*) >= 0.75 FROM j""",
)
def joined_series_coverage(spark, d):
    """L14."""
    li = table(spark, d, "lineitem")
    high = F.when((F.col("l_tax") > 0.07) & (F.month("l_shipdate") < 9), F.col("l_tax"))
    m = li.groupBy(F.trunc("l_shipdate", "month").alias("period")).agg(F.max("l_tax").alias("tax"), F.max(high).alias("high"))
    j = customer_months(spark, d).select("period").join(F.broadcast(m), "period", "left")  # one row per month
    return rounded(QA.coverage(j, ["tax", "high"]))


@query(
    "run_statistics",
    f"""WITH {CUSTOMER_MONTHS}
SELECT 'orders' AS stage, 1::BIGINT AS files, count(*) AS n_rows, count(DISTINCT o_custkey) AS entities,
  count(*) FILTER (WHERE o_totalprice > 300000) AS warnings, count(*) FILTER (WHERE o_orderdate IS NULL) AS errors, true AS timed FROM orders
UNION ALL SELECT 'months', 1, count(*), count(DISTINCT entity), count(*) FILTER (WHERE n_orders > 1),
  count(*) FILTER (WHERE amount <= 0), true FROM customer_months""",
)
def run_statistics(spark, d):
    """Files, rows, entities, warnings, errors and time of two stages; the report is
    saved as JSON and read back."""
    from tessella.operators.runs import STAGE, Run
    from tessella.session import scratch_path
    from tessella.sources.files import save_json

    run = Run(spark)
    orders = table(spark, d, "orders")
    run.stage("orders", orders, "o_custkey", F.col("o_totalprice") > 300000, F.col("o_orderdate").isNull())
    run.stage("months", customer_months(spark, d), "entity", F.col("n_orders") > 1, F.col("amount") <= 0)
    report = spark.read.schema(STAGE).json(save_json(run.report(), scratch_path(spark, "report")))
    return report.withColumn("timed", F.col("seconds") > 0).drop("seconds")

