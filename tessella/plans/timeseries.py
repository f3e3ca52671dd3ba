"""Series at several grains: reshape, expand, align, fill and compare."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import periods as PD
from tessella.operators import series as S
from tessella.plans.base import CUSTOMER_MONTHS, customer_months, moved, moved_sql, query, r, rounded, table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def priority_months(spark, d):
    return (
        table(spark, d, "orders")
        .groupBy(F.trunc("o_orderdate", "month").alias("date"), F.col("o_orderpriority").alias("series"))
        .agg(r(F.sum("o_totalprice"), 2).alias("value"))
    )


MONTHS = """months AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, o_orderpriority AS series,
  round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)"""

PIVOT = ", ".join(f"""max(value) FILTER (WHERE series = '{p}') AS "{p}" """ for p in PRIORITIES)


@query("long_to_wide", f"WITH {MONTHS} SELECT date, {PIVOT} FROM months GROUP BY 1")
def long_to_wide(spark, d):
    """G4 with an explicit series list."""
    m = priority_months(spark, d).withColumn("ord", F.lit(1))
    return S.long_to_wide(m, ["date"], "series", "value", "ord", PRIORITIES)


@query(
    "last_value_per_date_and_series",
    f"""WITH x AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, o_orderpriority AS series,
    arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus <> 'P') AS v FROM orders GROUP BY 1, 2)
SELECT date, {', '.join(f"""max(v) FILTER (WHERE series = '{s}') AS "{s}" """ for s in PRIORITIES)}
FROM x WHERE v IS NOT NULL GROUP BY 1""",
)
def last_value_per_date_and_series(spark, d):
    """Several rows per key, last non-null wins."""
    o = table(spark, d, "orders").select(
        F.trunc("o_orderdate", "month").alias("date"), F.col("o_orderpriority").alias("series"), "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("value"),
    )
    return S.long_to_wide(o, ["date"], "series", "value", "o_orderkey", PRIORITIES)


@query("wide_to_long", f"""WITH {MONTHS}, cal AS (SELECT DISTINCT date FROM months), s AS (SELECT DISTINCT series FROM months)
SELECT cal.date, s.series, m.value FROM cal CROSS JOIN s LEFT JOIN months m ON m.date = cal.date AND m.series = s.series""")
def wide_to_long(spark, d):
    """G1: unpivot by column-name pattern, null cells kept."""
    m = priority_months(spark, d).withColumn("ord", F.lit(1))
    wide = S.long_to_wide(m, ["date"], "series", "value", "ord", PRIORITIES)
    return S.wide_to_long(wide, ["date"], r"^\d-", "series", "value")


@query(
    "period_labels",
    """SELECT o_orderkey, last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)) AS quarter_end,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS month, make_date(year(o_orderdate), 1, 1) AS year FROM orders""",
)
def period_labels(spark, d):
    """Quarter, month and year labels to dates."""
    day = F.col("o_orderdate")
    y, q = F.year(day).cast("string"), F.quarter(day).cast("string")
    label = F.concat(y, F.lit("Q"), q, F.lit(" [YR"), y, F.lit("Q"), q, F.lit("]"))
    return table(spark, d, "orders").select(
        "o_orderkey", PD.quarter_end(label).alias("quarter_end"),
        PD.month_from_label(F.date_format(day, "yyyy'-M'MM")).alias("month"), PD.year_from_label(y).alias("year"),
    )


@query(
    "quarter_to_months",
    """WITH q AS (SELECT o_orderpriority AS series, last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)) AS quarter_end,
  round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)
SELECT series, quarter_end, value, last_day(CAST(quarter_end - to_months(i) AS DATE)) AS date FROM q, (SELECT unnest([0, 1, 2]) AS i)""",
)
def quarter_to_months(spark, d):
    """G3."""
    day = F.col("o_orderdate")
    q = F.last_day(F.make_date(F.year(day), F.quarter(day) * 3, F.lit(1)))
    per = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series"), q.alias("quarter_end")).agg(
        r(F.sum("o_totalprice"), 2).alias("value")
    )
    return S.quarter_to_months(per, "quarter_end")


@query(
    "daily_to_monthly",
    f"""WITH o AS ({moved_sql("2, 11")}),
m AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS date, round(avg(o_totalprice), 4) AS o_totalprice FROM o GROUP BY 1),
cal AS (SELECT last_day(CAST(unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS DATE)) AS date FROM o)
SELECT cal.date, m.o_totalprice FROM cal LEFT JOIN m USING (date)""",
)
def daily_to_monthly(spark, d):
    """Monthly means, empty months as null."""
    o = moved(table(spark, d, "orders"), [2, 11])
    return rounded(S.daily_to_monthly(o, "o_orderdate", "o_totalprice"), 4)


@query("mean_by_date", "SELECT CAST(o_orderdate AS DATE) AS date, round(avg(o_totalprice), 6) AS value FROM orders GROUP BY 1")
def mean_by_date(spark, d):
    """E12."""
    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("value"))
    return rounded(S.mean_by_date(o, ["date"], "value"))


SHIPPED = """shipped AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1),
ordered AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY 1),
urgent AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) AS "urgent.orders" FROM orders WHERE o_orderpriority = '1-URGENT'
  AND month(o_orderdate) < 7 GROUP BY 1)"""


def three_series(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    shipped = li.groupBy(F.trunc("l_shipdate", "month").alias("date")).agg(r(F.sum("l_quantity"), 2).alias("quantity"))
    ordered = o.groupBy(F.trunc("o_orderdate", "month").alias("date")).agg(r(F.sum("o_totalprice"), 2).alias("amount"))
    urgent = (
        o.filter((F.col("o_orderpriority") == "1-URGENT") & (F.month("o_orderdate") < 7))
        .groupBy(F.trunc("o_orderdate", "month").alias("date"))
        .agg(F.count("*").alias("urgent.orders"))
    )
    return shipped, ordered, urgent


@query(
    "outer_merged_series",
    f"""WITH {SHIPPED} SELECT date, quantity, amount, coalesce("urgent.orders", 0) AS "urgent.orders"
FROM shipped FULL JOIN ordered USING (date) FULL JOIN urgent USING (date)""",
)
def outer_merged_series(spark, d):
    """N-way outer merge in one aggregation; a dotted name survives."""
    merged = S.outer_merge(list(three_series(spark, d)), "date")
    return merged.withColumn("urgent.orders", F.coalesce(S.quoted("urgent.orders"), F.lit(0)).cast("long"))


@query(
    "stacked_series",
    f"""WITH {SHIPPED} SELECT date, 'QTY' AS series_code, 'Shipped quantity' AS indicator, quantity AS value FROM shipped
UNION ALL SELECT date, 'AMT', 'Order amount', amount FROM ordered""",
)
def stacked_series(spark, d):
    """G7."""
    shipped, ordered, _ = three_series(spark, d)
    return S.stack_series({"QTY": (shipped, "quantity", "Shipped quantity"), "AMT": (ordered, "amount", "Order amount")})


@query(
    "series_renamed_from_lookup",
    f"""WITH {MONTHS}, l AS (SELECT DISTINCT o_orderpriority AS series, split_part(o_orderpriority, '-', 2) AS label FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT m.series, m.date, m.value, coalesce(l.label, m.series) AS label FROM months m LEFT JOIN l USING (series)""",
)
def series_renamed_from_lookup(spark, d):
    """B27."""
    o = table(spark, d, "orders").filter("o_orderpriority <> '5-LOW'")
    lookup = o.select(F.col("o_orderpriority").alias("series"), F.split("o_orderpriority", "-")[1].alias("label")).distinct()
    return S.rename_from_lookup(priority_months(spark, d), lookup, "series", "label")


@query(
    "aligned_month_ends",
    """WITH a AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS date_m, round(sum(o_totalprice), 2) AS ordered FROM orders GROUP BY 1),
b AS (SELECT last_day(CAST(l_shipdate AS DATE)) AS date_m, round(sum(l_quantity), 2) AS shipped FROM lineitem GROUP BY 1)
SELECT date_m, ordered, shipped FROM a LEFT JOIN b USING (date_m)""",
)
def aligned_month_ends(spark, d):
    """Month-start and month-end sources joined on one key."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    starts = o.groupBy(F.trunc("o_orderdate", "month").alias("date")).agg(r(F.sum("o_totalprice"), 2).alias("ordered"))
    ends = li.groupBy(F.last_day("l_shipdate").alias("date")).agg(r(F.sum("l_quantity"), 2).alias("shipped"))
    a, b = S.align_month_end(starts, "date").drop("date"), S.align_month_end(ends, "date").drop("date")
    return a.join(b, "date_m", "left")


@query(
    "mixed_grain_join",
    f"""WITH {CUSTOMER_MONTHS},
a AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, round(sum(l_quantity), 2) AS annual_quantity FROM lineitem GROUP BY 1),
m AS (SELECT strftime(l_shipdate, '%Y-%m') AS year_month, round(sum(l_quantity), 2) AS monthly_quantity FROM lineitem GROUP BY 1)
SELECT entity, period, CAST(year(period) AS INTEGER) AS year, strftime(period, '%Y-%m') AS year_month, annual_quantity, monthly_quantity
FROM customer_months c LEFT JOIN a ON a.year = year(c.period) LEFT JOIN m ON m.year_month = strftime(c.period, '%Y-%m')""",
)
def mixed_grain_join(spark, d):
    """D8."""
    li = table(spark, d, "lineitem")
    annual = li.groupBy(F.year("l_shipdate").alias("year")).agg(r(F.sum("l_quantity"), 2).alias("annual_quantity"))
    monthly = li.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("year_month")).agg(
        r(F.sum("l_quantity"), 2).alias("monthly_quantity")
    )
    base = customer_months(spark, d).select("entity", "period")
    return S.join_mixed_grain(base, "period", annual, monthly)


@query(
    "annual_pct_change",
    """WITH y AS (SELECT o_orderpriority AS series, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)
SELECT series, year, value, round((value / nullif(lag(value) OVER (PARTITION BY series ORDER BY year), 0) - 1) * 100, 6) AS yoy FROM y""",
)
def annual_pct_change(spark, d):
    """F8."""
    y = table(spark, d, "orders").groupBy(
        F.col("o_orderpriority").alias("series"), F.year("o_orderdate").alias("year")
    ).agg(r(F.sum("o_totalprice"), 2).alias("value"))
    return S.pct_change(y, ["series"], "year", "value", "yoy").withColumn("yoy", r("yoy"))


@query(
    "relative_to_reference",
    """WITH y AS (SELECT o_orderpriority AS series, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)
SELECT a.series, a.year, a.value, round(a.value / nullif(b.value, 0), 6) AS share FROM y a LEFT JOIN y b ON b.year = a.year AND b.series = '5-LOW'""",
)
def relative_to_reference(spark, d):
    """D9."""
    y = table(spark, d, "orders").groupBy(
        F.col("o_orderpriority").alias("series"), F.year("o_orderdate").alias("year")
    ).agg(r(F.sum("o_totalprice"), 2).alias("value"))
    ref = y.filter("series = '5-LOW'").select("year", "value")
    return S.relative_to(y, ref, "year", "value", "value", "share").withColumn("share", r("share"))


@query(
    "filled_both_ways",
    f"""WITH {CUSTOMER_MONTHS}, x AS (SELECT entity, period, CASE WHEN amount > 250000 THEN amount END AS big FROM customer_months)
SELECT entity, period, coalesce(last_value(big IGNORE NULLS) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(big IGNORE NULLS) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS big FROM x""",
)
def filled_both_ways(spark, d):
    """F10."""
    m = customer_months(spark, d).select("entity", "period", F.when(F.col("amount") > 250000, F.col("amount")).alias("big"))
    return S.fill_both_ways(m, ["entity"], "period", ["big"])
