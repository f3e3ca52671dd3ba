"""Panel, presence, failure and calendar queries (customers and suppliers by month)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import panel as P
from tessella.operators.entities import dedupe_most_complete
from tessella.plans.base import (
    CUSTOMER_MONTHS,
    CUSTOMER_PANEL,
    SUPPLIER_MONTHS,
    customer_months,
    customer_panel,
    moved,
    moved_sql,
    query,
    r,
    rounded,
    supplier_months,
    table,
)
from tessella.session import split_by

E, D = "entity", "period"


@query(
    "silent_customers",
    f"""WITH {CUSTOMER_PANEL}
SELECT entity, count(*) AS total_observations, CAST(sum(present) AS BIGINT) AS present_observations,
       min(period) FILTER (WHERE present = 1) AS first_date,
       max(period) FILTER (WHERE present = 1) AS last_date,
       max(failed) AS is_failed, max(failure_date) AS failure_date,
       max(last_reporting_date) AS last_reporting_date,
       CAST(datediff('month', min(period) FILTER (WHERE present = 1),
            max(period) FILTER (WHERE present = 1)) + 1 AS INTEGER) AS months_covered
FROM panel GROUP BY entity""",
)
def silent_customers(spark, d):
    """E4 over D1, D2, F5, F6: which customers went silent, and when."""
    return P.entity_summary(customer_panel(spark, d), E, D)


@query(
    "panel_failure_flags",
    f"""WITH {CUSTOMER_PANEL}
SELECT entity, period, coalesce(n_orders, 0) AS n_orders, amount, present, last_reporting_date,
       failure_date, failed FROM panel""",
)
def panel_failure_flags(spark, d):
    """D1, D2, F5, F6 on the whole customer x month panel."""
    return customer_panel(spark, d).select(
        E, D, F.coalesce("n_orders", F.lit(0)).cast("long").alias("n_orders"), "amount", "present",
        "last_reporting_date", "failure_date", "failed",
    )


@query(
    "silent_without_spine",
    f"""WITH {CUSTOMER_MONTHS},
hi AS (SELECT max(period) AS h FROM customer_months)
SELECT entity, min(period) AS first_reporting_date, max(period) AS last_reporting_date,
       count(DISTINCT period) AS present_periods,
       CAST(datediff('month', max(period), any_value(h)) AS INTEGER) AS silent_periods,
       CASE WHEN datediff('month', max(period), any_value(h)) >= 6
            THEN CAST(max(period) + INTERVAL 1 MONTH AS DATE) END AS failure_date
FROM customer_months, hi GROUP BY entity""",
)
def silent_without_spine(spark, d):
    """F6 as one aggregation over raw orders, without building the panel."""
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias(E), F.col("o_orderdate").cast("date").alias(D)
    )
    return P.silent_entities(o, E, D)


@query(
    "panel_spine",
    f"""WITH {SUPPLIER_MONTHS},
cal AS (SELECT CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS DATE) AS period
        FROM supplier_months)
SELECT e.entity, c.period FROM (SELECT DISTINCT entity FROM supplier_months) e, cal c""",
)
def panel_spine(spark, d):
    """Every supplier with every month."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias(E), F.col("l_shipdate").cast("date").alias(D))
    lo, hi = P.month_range(li, D)
    return P.spine(li.select(E).distinct(), E, D, lo, hi)


TWO_TYPES = f"""{SUPPLIER_MONTHS},
orders_by_supplier AS (
  SELECT l_suppkey AS entity, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
         count(DISTINCT o_orderkey) AS n_orders
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY 1, 2),
keys AS (SELECT entity, period FROM supplier_months UNION ALL SELECT entity, period FROM orders_by_supplier),
cal AS (SELECT CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS DATE) AS period FROM keys),
grid AS (SELECT e.entity, c.period FROM (SELECT DISTINCT entity FROM keys) e, cal c)"""


@query(
    "panel_two_statement_types",
    f"""WITH {TWO_TYPES}
SELECT g.entity, g.period, s.price, o.n_orders,
       CASE WHEN s.entity IS NULL THEN 0 ELSE 1 END AS shipped_present,
       CASE WHEN o.entity IS NULL THEN 0 ELSE 1 END AS ordered_present,
       CASE WHEN s.entity IS NULL AND o.entity IS NULL THEN 0 ELSE 1 END AS present
FROM grid g LEFT JOIN supplier_months s ON s.entity = g.entity AND s.period = g.period
LEFT JOIN orders_by_supplier o ON o.entity = g.entity AND o.period = g.period""",
)
def panel_two_statement_types(spark, d):
    """Two statement types joined to one spine with a flag each."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    # Both sides are dealt by order once: the join and the distinct orders of a supplier
    # and month need no further shuffle, and only counts go on.
    n = li.count()
    joined = split_by(li, n, "l_orderkey").join(split_by(o, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = joined.select("o_orderkey", F.col("l_suppkey").alias(E), F.trunc("o_orderdate", "month").alias(D)).distinct()
    ordered = pairs.groupBy(E, D).agg(F.count("*").alias("n_orders"))
    shipped = supplier_months(spark, d).select(E, D, "price")
    return P.build_panel({"shipped": shipped, "ordered": ordered}, E, D)


@query(
    "first_record_per_period",
    """SELECT entity, period, o_orderkey, o_totalprice FROM (
  SELECT o_custkey AS entity, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, o_orderkey, o_totalprice,
         row_number() OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate)
                            ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
)
def first_record_per_period(spark, d):
    """First order per customer and month."""
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias(E), F.trunc("o_orderdate", "month").alias(D), "o_orderdate", "o_orderkey",
        "o_totalprice",
    )
    return P.first_per_key(o, [E, D], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "entity_timeline",
    """SELECT o_custkey AS entity, min(CAST(o_orderdate AS DATE)) AS first_seen,
       max(CAST(o_orderdate AS DATE)) AS last_seen,
       string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS types
FROM orders GROUP BY 1""",
)
def entity_timeline(spark, d):
    """First and last seen and the set of types."""
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias(E), F.col("o_orderdate").cast("date").alias(D), "o_orderpriority"
    )
    t = P.entity_timeline(o, E, D, "o_orderpriority")
    return t.withColumn("types", F.array_join("types", ","))


@query(
    "entity_lifespan",
    f"""WITH {SUPPLIER_MONTHS}
SELECT entity, min(period) AS "start", max(period) AS "end" FROM supplier_months
WHERE returned > 1e-9 OR discount > 1e-9 GROUP BY 1""",
)
def entity_lifespan(spark, d):
    """Lifespan from rows with real data."""
    return P.lifespan(supplier_months(spark, d), E, D, ["returned", "discount"])


@query(
    "blank_outside_lifespan",
    f"""WITH {CUSTOMER_PANEL},
life AS (SELECT entity, min(period) AS s, max(period) AS e FROM panel WHERE amount > 100000 GROUP BY 1)
SELECT p.entity, p.period,
       CASE WHEN p.period BETWEEN s AND e AND coalesce(p.period < p.failure_date, TRUE)
                 AND coalesce(p.amount > 1e-9, FALSE) THEN p.amount END AS amount,
       CASE WHEN p.period BETWEEN s AND e AND coalesce(p.period < p.failure_date, TRUE)
                 AND coalesce(p.amount > 1e-9, FALSE) THEN p.largest END AS largest
FROM panel p LEFT JOIN life l ON l.entity = p.entity""",
)
def blank_outside_lifespan(spark, d):
    """Blank measures outside the lifespan and after failure."""
    panel = customer_panel(spark, d)
    life = P.lifespan(customer_months(spark, d), E, D, ["amount"], eps=100000)
    out = P.blank_outside(panel, life, E, D, ["amount", "largest"], ["amount"], event="failure_date")
    return out.select(E, D, "amount", "largest")


@query(
    "period_summary",
    f"""WITH {CUSTOMER_PANEL}
SELECT period, count(*) AS total_entities, CAST(sum(present) AS BIGINT) AS present_entities,
       CAST(sum(failed) AS BIGINT) AS failed_entities, round(avg(present) * 100, 6) AS availability_rate
FROM panel GROUP BY 1""",
)
def period_summary(spark, d):
    """E5."""
    return rounded(P.period_summary(customer_panel(spark, d), E, D))


@query(
    "dataset_metadata",
    f"""WITH {CUSTOMER_PANEL}
SELECT count(*) AS total_rows, count(DISTINCT entity) AS entities, min(period) AS first_period,
       max(period) AS last_period,
       count(DISTINCT CASE WHEN failed = 1 THEN entity END) AS failed_entities,
       count(DISTINCT entity) - count(DISTINCT CASE WHEN failed = 1 THEN entity END) AS active_entities,
       round(sum(present) / count(*) * 100, 6) AS availability_rate FROM panel""",
)
def dataset_metadata(spark, d):
    """E6."""
    return rounded(P.dataset_metadata(customer_panel(spark, d), E, D))


GAPPY = "CAST(o_orderdate AS DATE) AS period FROM orders WHERE month(o_orderdate) NOT IN (4, 9)"


@query(
    "period_coverage",
    f"""WITH f AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM ({moved_sql("4, 9")})),
cal AS (SELECT CAST(unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS DATE) AS m FROM f),
miss AS (SELECT string_agg(strftime(m, '%Y-%m'), ',' ORDER BY m) AS x FROM cal WHERE m NOT IN (SELECT m FROM f))
SELECT strftime(min(f.m), '%Y-%m') AS start_month, strftime(max(f.m), '%Y-%m') AS end_month,
       count(*) AS found_months, CAST((SELECT count(*) FROM cal) AS INTEGER) AS expected_months,
       (SELECT x FROM miss) AS missing_months,
       round(count(*) / (SELECT count(*) FROM cal), 6) AS coverage_ratio FROM f""",
)
def period_coverage(spark, d):
    """E8 over the months that have orders, two calendar months having moved on."""
    o = moved(table(spark, d, "orders"), [4, 9])
    return rounded(P.period_coverage(o.select(F.col("o_orderdate").cast("date").alias(D)), D))


@query(
    "missing_periods",
    f"""WITH f AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM ({moved_sql("4, 9")})),
cal AS (SELECT CAST(unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS DATE) AS m FROM f)
SELECT m AS missing_period FROM cal WHERE m NOT IN (SELECT m FROM f)""",
)
def missing_periods(spark, d):
    """Expected months not found."""
    o = moved(table(spark, d, "orders"), [4, 9])
    return P.missing_periods(o.select(F.col("o_orderdate").cast("date").alias(D)), D)


@query(
    "survivor_rows",
    f"""WITH {CUSTOMER_PANEL}
SELECT entity, count(*) AS n, round(sum(amount), 2) AS amount FROM panel WHERE failed = 0 GROUP BY 1""",
)
def survivor_rows(spark, d):
    """Rows that are not failed."""
    s = P.survivors(customer_panel(spark, d))
    return s.groupBy(E).agg(F.count("*").alias("n"), r(F.sum("amount"), 2).alias("amount"))


@query(
    "events_per_month",
    f"""WITH {CUSTOMER_PANEL},
first AS (SELECT entity, min(period) AS event_date FROM panel WHERE failed = 1 GROUP BY 1),
per AS (SELECT c.period, count(f.entity) AS events FROM cal c LEFT JOIN first f ON f.event_date = c.period GROUP BY 1)
SELECT period, events, CAST(sum(events) OVER (ORDER BY period ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_events
FROM per""",
)
def events_per_month(spark, d):
    """First failures per month, zero-filled, with running total."""
    return P.events_per_period(customer_panel(spark, d), E, D, "failed")


@query(
    "event_timeline",
    f"""WITH {CUSTOMER_PANEL}
SELECT entity, min(period) AS event_date FROM panel WHERE failed = 1 GROUP BY 1 ORDER BY event_date, entity""",
)
def event_timeline(spark, d):
    """First failure date per entity, ordered."""
    return P.first_events(customer_panel(spark, d), E, D, "failed").orderBy("event_date", E)


@query(
    "attributes_by_period",
    f"""WITH {CUSTOMER_MONTHS},
monthly AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period, round(avg(l_discount), 6) AS mean_discount
            FROM lineitem GROUP BY 1)
SELECT c.entity, c.period, c.amount, m.mean_discount
FROM customer_months c LEFT JOIN monthly m ON m.period = c.period""",
)
def attributes_by_period(spark, d):
    """D3: one macro row per month replicated over entities."""
    monthly = (
        table(spark, d, "lineitem")
        .groupBy(F.trunc("l_shipdate", "month").alias(D))
        .agg(r(F.avg("l_discount")).alias("mean_discount"))
    )
    base = customer_months(spark, d).select(E, D, "amount")
    return base.join(F.broadcast(monthly), D, "left")  # one row per month


@query(
    "entity_attributes",
    f"""WITH {CUSTOMER_MONTHS}
SELECT m.entity, m.period, m.amount, c.c_mktsegment AS segment
FROM customer_months m LEFT JOIN customer c ON c.c_custkey = m.entity""",
)
def entity_attributes(spark, d):
    """Entity attributes and ratios joined on the left."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias(E), F.col("c_mktsegment").alias("segment"))
    return customer_months(spark, d).select(E, D, "amount").join(c, E, "left")


@query(
    "active_in_range",
    f"""WITH {CUSTOMER_MONTHS},
life AS (SELECT entity, min(period) AS s, CAST(min(period) + INTERVAL 24 MONTH AS DATE) AS e
         FROM customer_months GROUP BY 1)
SELECT m.entity, m.period, m.n_orders, (m.period BETWEEN l.s AND l.e) AS in_first_years
FROM customer_months m JOIN life l ON l.entity = m.entity""",
)
def active_in_range(spark, d):
    """Range predicate after the equi-join."""
    m = customer_months(spark, d)
    life = m.groupBy(E).agg(F.min(D).alias("s"), F.add_months(F.min(D), 24).alias("e"))
    joined = m.join(life, E)
    return joined.select(E, D, "n_orders", F.col(D).between(F.col("s"), F.col("e")).alias("in_first_years"))


@query(
    "membership_slice",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
  AND o_orderdate >= TIMESTAMP '1998-01-01'""",
)
def membership_slice(spark, d):
    """Semi join on an entity list after a pushed date cutoff."""
    keep = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, d, "orders").filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return o.select("o_orderkey", "o_custkey", "o_totalprice").join(keep, "o_custkey", "left_semi")


@query(
    "union_of_types",
    """SELECT DISTINCT entity, period FROM (
  SELECT l_suppkey AS entity, CAST(last_day(l_shipdate) AS DATE) AS period FROM lineitem
  UNION ALL SELECT s_suppkey, DATE '1995-01-31' FROM supplier)""",
)
def union_of_types(spark, d):
    """Distinct entities and dates over several types."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias(E), F.last_day("l_shipdate").alias(D))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias(E), F.lit("1995-01-31").cast("date").alias(D))
    return P.union_keys([li, s], [E, D])


@query(
    "sorted_panel",
    f"""WITH {SUPPLIER_MONTHS} SELECT entity, period, price FROM supplier_months ORDER BY entity, period""",
)
def sorted_panel(spark, d):
    """H1: total sort at the sink."""
    return supplier_months(spark, d).select(E, D, "price").orderBy(E, D)


@query(
    "most_complete_row",
    """SELECT entity, period, l_orderkey, l_linenumber, returned, taxed, filled FROM (
  SELECT *, row_number() OVER (PARTITION BY entity, period ORDER BY filled DESC, l_orderkey, l_linenumber, price) AS rn
  FROM (SELECT *, (returned IS NOT NULL)::INT + (taxed IS NOT NULL)::INT AS filled FROM (
    SELECT l_suppkey AS entity, CAST(date_trunc('month', l_shipdate) AS DATE) AS period, l_orderkey, l_linenumber,
           l_extendedprice AS price, CASE WHEN l_returnflag = 'R' THEN l_extendedprice END AS returned,
           CASE WHEN l_tax > 0.02 THEN l_tax END AS taxed FROM lineitem))) WHERE rn = 1""",
)
def most_complete_row(spark, d):
    """Fullest row per (entity, period), first on ties."""
    li = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias(E),
        F.trunc("l_shipdate", "month").alias(D),
        "l_orderkey",
        "l_linenumber",
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).alias("returned"),
        F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("taxed"),
    )
    best = dedupe_most_complete(li, [E, D], ["returned", "taxed"], ["l_orderkey", "l_linenumber", "price"])
    filled = F.col("returned").isNotNull().cast("int") + F.col("taxed").isNotNull().cast("int")
    return best.withColumn("filled", filled).drop("price")
