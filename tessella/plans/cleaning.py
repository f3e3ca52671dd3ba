"""Scans, cell grids, cleaning and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import numeric as N
from tessella.functions import periods as PD
from tessella.functions import text as TX
from tessella.operators.features import drop_matching, feature_columns, usable_columns
from tessella.plans.base import (
    SUPPLIER_MONTHS,
    query,
    r,
    rounded,
    supplier_months,
    table,
)
from tessella.session import scratch_path
from tessella.sources import cells as C
from tessella.sources import files as FS

# ------------------------------------------------------------ scans and sinks

DAILY = """daily AS (
  SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, round(sum(o_totalprice), 2) AS amount
  FROM orders GROUP BY 1)"""


def daily_orders(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(
        F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("amount")
    )


@query("csv_typed_scan", f"WITH {DAILY} SELECT * FROM daily")
def csv_typed_scan(spark, d):
    """Gzip CSV snapshot written and scanned back with a schema and a date format."""
    folder = scratch_path(spark, "csv")
    out = daily_orders(spark, d).withColumn("day", F.date_format("day", "dd.MM.yyyy"))
    path = FS.save_csv(out, folder, "20200101_000000")
    return FS.scan_csv(spark, path, "day string, n long, amount double", {"day": "dd.MM.yyyy"})


@query("csv_text_scan", f"WITH {DAILY} SELECT strftime(day, '%Y-%m-%d') AS day, CAST(n AS VARCHAR) AS n FROM daily")
def csv_text_scan(spark, d):
    """A1: all-string scan."""
    path = FS.save_csv(daily_orders(spark, d).select("day", "n"), scratch_path(spark, "csv"), "1", compress=False)
    return FS.scan_csv(spark, path)


@query("parquet_sink", f"WITH {DAILY} SELECT *, CAST(year(day) AS INTEGER) AS year FROM daily")
def parquet_sink(spark, d):
    """A10: year-partitioned parquet written and read back."""
    df = daily_orders(spark, d).withColumn("year", F.year("day"))
    return spark.read.parquet(FS.save_parquet(df, scratch_path(spark, "parquet"), ["year"]))


@query("json_manifest", f"WITH {DAILY} SELECT count(*) AS days, min(day) AS first_day, max(day) AS last_day FROM daily")
def json_manifest(spark, d):
    """Nested manifest written as JSON and read back."""
    m = daily_orders(spark, d).agg(
        F.struct(F.count("*").alias("days"), F.min("day").alias("lo"), F.max("day").alias("hi")).alias("span")
    )
    path = FS.save_json(m, scratch_path(spark, "json"))
    back = spark.read.schema("span struct<days:long,lo:date,hi:date>").json(path)
    return back.select(
        F.col("span.days").alias("days"), F.col("span.lo").alias("first_day"), F.col("span.hi").alias("last_day")
    )


@query("stage_table", f"WITH {DAILY} SELECT day, n FROM daily WHERE n > 3")
def stage_table(spark, d):
    """A stage is written and the next step reads the written table."""
    staged = FS.save_stage(daily_orders(spark, d), scratch_path(spark, "stages"), "daily")
    return staged.filter("n > 3").select("day", "n")


@query(
    "cutoff_rewrite",
    f"""WITH {DAILY} SELECT 'daily' AS table_name, count(*) AS rows_before,
    count(*) FILTER (WHERE day >= DATE '1998-01-01') AS rows_after,
    count(*) FILTER (WHERE day < DATE '1998-01-01') AS rows_removed FROM daily""",
)
def cutoff_rewrite(spark, d):
    """Manifest-driven truncation into a new folder with counts."""
    work = scratch_path(spark, "rewrite")
    daily_orders(spark, d).write.parquet(f"{work}/in")
    return FS.rewrite_truncated(spark, {"daily": f"{work}/in"}, f"{work}/out", "day", "1998-01-01")


@query("latest_month_file", "SELECT strftime(max(o_orderdate), 'part_%Y') AS file, 1::BIGINT AS n FROM orders")
def latest_month_file(spark, d):
    """Discover written files and pick the latest by name."""
    path = scratch_path(spark, "snapshots")
    years = table(spark, d, "orders").select(F.date_format("o_orderdate", "'part_'yyyy").alias("label"), "o_orderkey")
    years.write.partitionBy("label").parquet(path)
    files = FS.discover(spark, path, "*.parquet").withColumn("file", F.regexp_extract("path", "label=([^/]+)", 1))
    return FS.latest(files).select("file").distinct().withColumn("n", F.lit(1).cast("long"))


@query("discovered_files")
def discovered_files(spark, d):
    """A2: the input tables as files with size and name."""
    return FS.discover(spark, d, "*.parquet").select("file", "length").orderBy("file")


FILE_NAMES = """names AS (
  SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, 'aggregation_%Y-%m-01_eng.xlsx')
    WHEN 'O' THEN strftime(o_orderdate, 'aggregation_%Y%m_eng.xlsx') ELSE 'notes.xlsx' END AS file FROM orders)"""


def _file_names(spark, d):
    o = table(spark, d, "orders")
    name = (
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "'aggregation_'yyyy-MM'-01_eng.xlsx'"))
        .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "'aggregation_'yyyyMM'_eng.xlsx'"))
        .otherwise("notes.xlsx")
    )
    return o.select(name.alias("file")).distinct()


@query(
    "period_from_file_name",
    f"""WITH {FILE_NAMES}
SELECT file, CASE WHEN file LIKE 'agg%' THEN CAST(strptime(regexp_extract(file, '(\\d{{4}})[^\\d]?(\\d{{2}})', 1)
  || regexp_extract(file, '(\\d{{4}})[^\\d]?(\\d{{2}})', 2), '%Y%m') AS DATE) END AS period FROM names""",
)
def period_from_file_name(spark, d):
    """A3."""
    return _file_names(spark, d).withColumn("period", PD.period_from_name(F.col("file")))


# ------------------------------------------------------------------ cell grid
#
# One file per month, one sheet per return flag, one row per supplier; the
# header moves between rows 3 and 7 with the month; every sheet ends in junk.


def cell_grid(spark, d):
    li = table(spark, d, "lineitem")
    facts = li.groupBy(
        F.date_format("l_shipdate", "'aggregation_'yyyy-MM'-01_eng.xlsx'").alias("file"),
        F.month("l_shipdate").alias("m"),
        "l_returnflag",
        "l_suppkey",
    ).agg(r(F.sum("l_quantity"), 2).alias("qty"), r(F.sum("l_extendedprice"), 2).alias("price"))
    sheet = (
        F.when(F.col("l_returnflag") == "A", "Assets")
        .when(F.col("l_returnflag") == "N", "Total liabilities")
        .otherwise("Equity_NC")
    )
    base = facts.withColumn("sheet", sheet).withColumn("row", (F.col("l_suppkey") + 8).cast("int"))
    sheets = base.select("file", "sheet", "m").distinct().withColumn("head", F.col("m") % 5 + 3)

    def cell(row, col, value):
        return F.struct(F.col(row).alias("row"), F.lit(col).alias("col"), value.alias("value"))

    body = base.select(
        "file",
        "sheet",
        F.inline(
            F.array(
                cell("row", 0, F.concat(F.lit(" Supplier "), F.col("l_suppkey").cast("string"))),
                cell("row", 1, F.col("qty").cast("decimal(18,2)").cast("string")),
                cell("row", 2, F.col("price").cast("decimal(18,2)").cast("string")),
            )
        ),
    )
    heads = sheets.select(
        "file",
        "sheet",
        F.inline(
            F.array(
                cell("head", 0, F.lit("Bank")),
                cell("head", 1, F.lit("Total quantity")),
                cell("head", 2, F.lit("Total price")),
            )
        ),
    )
    junk = sheets.select(
        "file",
        "sheet",
        F.posexplode(F.array(*[F.lit(t) for t in ["Total", "Source: ledger", "* note", "---", "ВСЬОГО", "  "]])).alias("i", "value"),
    ).select("file", "sheet", (F.col("i") + 100000000).cast("int").alias("row"), F.lit(0).alias("col"), "value")
    return body.unionByName(heads).unionByName(junk)


GRID = """facts AS (
  SELECT strftime(l_shipdate, 'aggregation_%Y-%m-01_eng.xlsx') AS file, CAST(month(l_shipdate) AS INTEGER) AS m,
    CASE l_returnflag WHEN 'A' THEN 'Assets' WHEN 'N' THEN 'Total liabilities' ELSE 'Equity_NC' END AS sheet,
    l_suppkey, CAST(l_suppkey + 8 AS INTEGER) AS "row", round(sum(l_quantity), 2) AS qty,
    round(sum(l_extendedprice), 2) AS price
  FROM lineitem GROUP BY ALL),
sheets AS (SELECT DISTINCT file, sheet, m, m % 5 + 3 AS head FROM facts),
junk AS (SELECT * FROM (VALUES (0, 'Total'), (1, 'Source: ledger'), (2, '* note'), (3, '---'), (4, 'ВСЬОГО'), (5, '  ')) t(i, value)),
grid AS (
  SELECT file, sheet, "row", 0 AS col, ' Supplier ' || l_suppkey AS value FROM facts
  UNION ALL SELECT file, sheet, "row", 1, CAST(CAST(qty AS DECIMAL(18,2)) AS VARCHAR) FROM facts
  UNION ALL SELECT file, sheet, "row", 2, CAST(CAST(price AS DECIMAL(18,2)) AS VARCHAR) FROM facts
  UNION ALL SELECT file, sheet, head, 0, 'Bank' FROM sheets
  UNION ALL SELECT file, sheet, head, 1, 'Total quantity' FROM sheets
  UNION ALL SELECT file, sheet, head, 2, 'Total price' FROM sheets
  UNION ALL SELECT file, sheet, 100000000 + i, 0, value FROM sheets, junk)"""


@query("detect_header_row", f"WITH {GRID} SELECT file, sheet, head AS header_row FROM sheets")
def detect_header_row(spark, d):
    """A5."""
    return C.detect_header(cell_grid(spark, d))


@query(
    "grid_to_records",
    f"""WITH {GRID} SELECT file, sheet, 'Supplier ' || l_suppkey AS bank_name,
  CAST(CAST(qty AS DECIMAL(18,2)) AS VARCHAR) AS "total quantity",
  CAST(CAST(price AS DECIMAL(18,2)) AS VARCHAR) AS "total price" FROM facts""",
)
def grid_to_records(spark, d):
    """Header promoted, grid reshaped, noise rows dropped."""
    grid = cell_grid(spark, d)
    records = C.cells_to_records(grid, ["Total quantity", "Total price"])
    return C.drop_noise_rows(records, "bank_name").drop("row")


SHEETS = """sheet_names AS (
  SELECT DISTINCT CAST(o_custkey % 40 AS VARCHAR) AS file, o_orderpriority, o_orderstatus FROM orders),
listed AS (
  SELECT file, CASE o_orderpriority WHEN '1-URGENT' THEN 'Assets' WHEN '2-HIGH' THEN 'Total_assets'
    WHEN '3-MEDIUM' THEN 'Liabilties' WHEN '4-NOT SPECIFIED' THEN 'Fin results' ELSE 'Shareholders equity' END
    || CASE o_orderstatus WHEN 'O' THEN '' WHEN 'F' THEN '_NC' ELSE ' old' END AS sheet,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 10 + CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS ord
  FROM sheet_names WHERE NOT (CAST(file AS INTEGER) % 3 = 0 AND o_orderpriority = '1-URGENT'))"""


def sheet_list(spark, d):
    o = table(spark, d, "orders")
    names = o.select(
        (F.col("o_custkey") % 40).cast("string").alias("file"), "o_orderpriority", "o_orderstatus"
    ).distinct()
    kind = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "Assets")
        .when(F.col("o_orderpriority") == "2-HIGH", "Total_assets")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "Liabilties")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Fin results")
        .otherwise("Shareholders equity")
    )
    status = F.col("o_orderstatus")
    tail = F.when(status == "O", "").when(status == "F", "_NC").otherwise(" old")
    place = F.when(status == "O", 0).when(status == "F", 1).otherwise(2)
    kept = names.filter(~((F.col("file").cast("int") % 3 == 0) & (F.col("o_orderpriority") == "1-URGENT")))
    return kept.select(
        "file",
        F.concat(kind, tail).alias("sheet"),
        (F.substring("o_orderpriority", 1, 1).cast("int") * 10 + place).alias("ord"),
    )


# Fixed values within the SQL: the sheet-name patterns per statement type, in rank order, and the clean labels.
@query(
    "choose_sheet",
    f"""WITH {SHEETS},
usd AS (SELECT * FROM listed WHERE NOT ends_with(sheet, '_NC')),
pats AS (SELECT * FROM (VALUES ('assets', 0, '^assets?$'), ('assets', 1, '^total[ _]+assets?$'),
  ('liabilities', 0, '^liabilities?$'), ('liabilities', 1, '^total[ _]+liab'),
  ('equity', 0, '^equity$'), ('equity', 1, '^shareholders?[ _]+equity$'), ('equity', 2, '^total[ _]+equity$'),
  ('financial_results', 0, '^financial[ _]+results?_?$'), ('financial_results', 1, '^fin[ _]*results?_?$'),
  ('financial_results', 2, '^financial.*res_?$')) t(data_type, rk, pat)),
labs AS (SELECT * FROM (VALUES ('assets', 'assets'), ('liabilities', 'liabilities'), ('equity', 'equity'),
  ('financial_results', 'financial results')) t(data_type, label)),
hits AS (SELECT u.file, p.data_type, u.sheet, u.ord, p.rk, 1.0::DOUBLE AS near FROM usd u JOIN pats p
         ON regexp_matches(lower(u.sheet), p.pat)),
keyed AS (SELECT *, array_to_string(list_sort(list_filter(regexp_split_to_array(lower(trim(sheet)), '[^\\p{{L}}\\p{{N}}]+'),
          lambda w: w <> '')), ' ') AS k FROM usd),
near AS (SELECT file, data_type, sheet, ord, 99 AS rk,
         1.0 - levenshtein(k, label) / greatest(length(k), length(label)) AS near FROM keyed, labs),
allc AS (SELECT * FROM hits UNION ALL SELECT * FROM near WHERE near >= 0.8),
best AS (SELECT *, row_number() OVER (PARTITION BY file, data_type ORDER BY rk, near DESC, ord) AS rn FROM allc)
SELECT file, data_type, sheet, CASE WHEN rk < 99 THEN 'pattern' ELSE 'fuzzy' END AS via FROM best WHERE rn = 1""",
)
def choose_sheet(spark, d):
    """A4."""
    return C.choose_sheet(sheet_list(spark, d))


@query(
    "sheet_categories",
    f"""WITH {SHEETS},
cat AS (SELECT file, sheet, CASE WHEN lower(sheet) LIKE '%asset%' THEN 'assets' WHEN lower(sheet) LIKE '%liabilit%' THEN 'liabilities'
  WHEN lower(sheet) LIKE '%equity%' OR lower(sheet) LIKE '%capital%' THEN 'equity'
  WHEN regexp_matches(lower(sheet), 'fin.*result') THEN 'financial_results' ELSE 'unknown' END AS category FROM listed)
SELECT category, count(DISTINCT file) AS files, count(*) AS sheets FROM cat GROUP BY 1""",
)
def sheet_categories(spark, d):
    """A7."""
    return C.categorize(sheet_list(spark, d))


@query(
    "sheet_structure",
    f"""WITH {GRID} SELECT file, sheet, max("row") + 1 AS n_rows,
  count(DISTINCT "row") FILTER (WHERE trim(value) <> '') AS non_empty_rows, max(col) + 1 AS n_cols
FROM grid GROUP BY 1, 2""",
)
def sheet_structure(spark, d):
    """E22."""
    return C.sheet_structure(cell_grid(spark, d))


@query(
    "entities_per_file",
    f"""WITH {GRID}, n AS (SELECT file, count(DISTINCT l_suppkey) + 3 AS c FROM facts GROUP BY 1)
SELECT file, c AS entity_count, CASE WHEN c < 10 THEN 'low' WHEN c > 200 THEN 'high' ELSE 'ok' END AS band FROM n""",
)
def entities_per_file(spark, d):
    """Distinct names without aggregate rows (notes and rules still count here)."""
    grid = cell_grid(spark, d)
    records = C.cells_to_records(grid, ["Total quantity"])
    return C.entity_estimate(records, ["file"], "bank_name")


@query(
    "file_validity",
    f"""WITH {GRID}
SELECT file, count(DISTINCT sheet) AS sheets, count(DISTINCT CASE WHEN sheet <> 'Equity_NC' THEN sheet END) AS valid_sheets,
  0::BIGINT AS unknown_sheets, count(CASE WHEN sheet <> 'Equity_NC' THEN 1 END) > 0 AS is_valid FROM sheets GROUP BY 1""",
)
def file_validity(spark, d):
    """L16 per file."""
    grid = cell_grid(spark, d)
    records = C.drop_noise_rows(C.cells_to_records(grid, ["Total quantity"]), "bank_name")
    return C.file_validity(grid, C.entity_estimate(records, ["file", "sheet"], "bank_name"))


@query(
    "file_validity_totals",
    f"""WITH {GRID}, f AS (SELECT file, bool_or(sheet <> 'Equity_NC') AS v FROM sheets GROUP BY 1)
SELECT count(*) AS files, count(*) FILTER (WHERE v) AS valid_files, count(*) FILTER (WHERE NOT v) AS invalid_files FROM f""",
)
def file_validity_totals(spark, d):
    """L16 totals."""
    return C.validity_totals(file_validity(spark, d))


# ------------------------------------------------------- text and projections

NOISY = """noisy AS (SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN 'TOTAL assets' WHEN 1 THEN 'Всього по банках'
  WHEN 2 THEN '* ' || s_name WHEN 3 THEN '----' WHEN 4 THEN '   ' WHEN 5 THEN 'Notes: x' WHEN 6 THEN ' ' || s_name ELSE s_name END AS name
  FROM supplier)"""


@query("noise_rows_dropped", f"WITH {NOISY} SELECT s_suppkey, name FROM noisy WHERE s_suppkey % 8 IN (6, 7)")
def noise_rows_dropped(spark, d):
    """B1."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey") % 8
    name = (
        F.when(k == 0, "TOTAL assets").when(k == 1, "Всього по банках")
        .when(k == 2, F.concat(F.lit("* "), "s_name")).when(k == 3, "----").when(k == 4, "   ")
        .when(k == 5, "Notes: x").when(k == 6, F.concat(F.lit(" "), "s_name")).otherwise(F.col("s_name"))
    )
    return C.drop_noise_rows(s.select("s_suppkey", name.alias("name")), "name")


@query(
    "clean_numeric_text",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 6 WHEN 0 THEN NULL WHEN 1 THEN l_extendedprice
  WHEN 2 THEN -l_extendedprice WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE l_extendedprice END AS value FROM lineitem""",
)
def clean_numeric_text(spark, d):
    """B2: thousands separators, Unicode minus, markers and junk."""
    li = table(spark, d, "lineitem")
    k, num = F.col("l_linenumber") % 6, F.format_number("l_extendedprice", 2)
    raw = (
        F.when(k == 0, "-").when(k == 1, num).when(k == 2, F.concat(F.lit("−"), num)).when(k == 3, F.concat(num, F.lit("d")))
        .when(k == 4, "None").otherwise(F.concat(F.lit(" "), num, F.lit(" ")))
    )
    return li.select("l_orderkey", "l_linenumber", "l_partkey", TX.clean_numeric(raw).alias("value"))


@query("clean_percent_text", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_tax * 100, 2) AS pct FROM lineitem")
def clean_percent_text(spark, d):
    """B2: percent variant."""
    li = table(spark, d, "lineitem")
    raw = F.concat(F.format_number(F.col("l_tax") * 100, 2), F.lit(" %"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", TX.clean_numeric(raw, percent=True).alias("pct"))


@query(
    "normalized_headers",
    """SELECT p_partkey, lower(replace(p_name, ' ', '_')) || '_' || lower(regexp_replace(p_brand, '#', '_')) || '_' || p_size
  AS header FROM part""",
)
def normalized_headers(spark, d):
    """B3 as a column function."""
    raw = F.concat(F.lit("  "), F.upper("p_name"), F.lit(" — ("), F.col("p_brand"), F.lit(")  "), F.col("p_size"), F.lit("%"))
    return table(spark, d, "part").select("p_partkey", TX.normalize_name(raw).alias("header"))


@query(
    "prefixed_columns",
    f"WITH {SUPPLIER_MONTHS} SELECT entity, period, price AS assets_total_price, tax AS assets_tax_paid FROM supplier_months",
)
def prefixed_columns(spark, d):
    """Schema-side normalisation with a statement prefix."""
    m = supplier_months(spark, d).select("entity", "period", F.col("price").alias("Total  price"), F.col("tax").alias("Tax (paid)"))
    names = {c: f"assets_{TX.normalize_header(c)}" for c in m.columns if c not in ("entity", "period")}
    return m.withColumnsRenamed(names)


@query(
    "standard_periods",
    """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, last_day(CAST(o_orderdate AS DATE)) AS month_end,
  strftime(o_orderdate, '%Y-%m') AS year_month FROM orders""",
)
def standard_periods(spark, d):
    """B4."""
    day = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", PD.to_period(day, "start").alias("month_start"), PD.to_period(day, "end").alias("month_end"),
        PD.to_period(day, "label").alias("year_month"),
    )


@query("blank_keys_dropped", "SELECT doc_id, trim(source) AS key FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0")
def blank_keys_dropped(spark, d):
    """B5."""
    k = F.when(F.col("doc_id") % 5 == 0, "  ").when(F.col("doc_id") % 7 != 0, F.concat(F.lit(" "), "source", F.lit(" ")))
    df = table(spark, d, "documents").select("doc_id", F.trim(k).alias("key"))
    return df.filter(F.length("key") > 0)


@query("matching_columns_dropped", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def matching_columns_dropped(spark, d):
    """Drop by prefix, suffix, pattern, and standardised twins."""
    li = table(spark, d, "lineitem").withColumn("l_quantity_z", F.col("l_quantity") * 0)
    return drop_matching(li, prefixes=("l_ship", "l_part"), suffixes=("flag", "status"), regex="(?i)supp|price|disc|tax")


@query(
    "usable_variables",
    f"""WITH {SUPPLIER_MONTHS}, x AS (SELECT *, 1.0 AS constant, CASE WHEN quantity > 400 THEN tax END AS rare FROM supplier_months)
SELECT column_name, round(s, 6) AS non_null_share, round(dev, 4) AS deviation, FALSE AS has_infinite,
  s >= 0.5 AND dev > 0 AS usable FROM (
  SELECT 'price' AS column_name, avg((price IS NOT NULL)::INT) AS s, stddev_samp(price) AS dev FROM x UNION ALL
  SELECT 'returned', avg((returned IS NOT NULL)::INT), stddev_samp(returned) FROM x UNION ALL
  SELECT 'constant', 1.0, 0.0 UNION ALL
  SELECT 'rare', avg((rare IS NOT NULL)::INT), stddev_samp(rare) FROM x)""",
)
def usable_variables(spark, d):
    """B9."""
    m = supplier_months(spark, d).withColumn("constant", F.lit(1.0)).withColumn(
        "rare", F.when(F.col("quantity") > 400, F.col("tax"))
    )
    out = usable_columns(m, ["price", "returned", "constant", "rare"])
    return out.withColumns({"non_null_share": r("non_null_share"), "deviation": r("deviation", 4)})


@query(
    "feature_selector",
    "SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_linenumber']) AS column_name",
)
def feature_selector(spark, d):
    """Numeric, non-constant, no ids, no outcome names."""
    li = table(spark, d, "lineitem").withColumn("constant", F.lit(3)).withColumn("failed_soon", F.col("l_tax"))
    return feature_columns(li, ["l_orderkey", "l_partkey", "l_suppkey"])


@query(
    "ratio_guards",
    f"""WITH {SUPPLIER_MONTHS}
SELECT entity, period, round(returned / nullif(price, 0), 6) AS returned_share,
  round((coalesce(returned, 0) + coalesce(discount, 0)) / nullif(price, 0), 6) AS skip_null_share,
  round(CASE WHEN price > 0 THEN ln(price) END, 6) AS log_price, round(tax - discount, 4) AS tax_gap,
  round(CASE WHEN returned IS NOT NULL THEN greatest(least(returned / nullif(price, 0), 0.5), 0.1) END, 6) AS clipped,
  CAST(period >= DATE '1998-03-01' AS INTEGER) AS regime,
  round(CAST(period >= DATE '1998-03-01' AS INTEGER) * returned, 2) AS regime_x_returned,
  CAST(year(period) AS INTEGER) AS year, CAST(quarter(period) AS INTEGER) AS quarter, CAST(month(period) AS INTEGER) AS month
FROM supplier_months""",
)
def ratio_guards(spark, d):
    """B16, B17, B18, B21, B22, B23, B24, B25."""
    from tessella.operators.ratios import interact

    m = supplier_months(spark, d).withColumn("regime", N.regime_flag(F.col("period"), "1998-03-01"))
    share = N.safe_ratio(F.col("returned"), F.col("price"))
    return interact(m, "regime", ["returned"]).select(
        "entity", "period",
        r(share).alias("returned_share"),
        r(N.sum_ratio([F.col("returned"), F.col("discount")], F.col("price"))).alias("skip_null_share"),
        r(N.log_size(F.col("price"))).alias("log_price"),
        r(N.spread(F.col("tax"), F.col("discount")), 4).alias("tax_gap"),
        r(N.clip(share, 0.1, 0.5)).alias("clipped"),
        "regime",
        r("regime_x_returned", 2).alias("regime_x_returned"),
        *[c.alias(n) for n, c in PD.calendar_parts(F.col("period")).items()],
    )


@query(
    "listwise_deletion",
    f"WITH {SUPPLIER_MONTHS} SELECT entity, period, returned FROM supplier_months WHERE returned IS NOT NULL AND tax IS NOT NULL",
)
def listwise_deletion(spark, d):
    """B28."""
    return supplier_months(spark, d).na.drop(subset=["returned", "tax"]).select("entity", "period", "returned")


@query(
    "roles_detected",
    """WITH s AS (SELECT count(DISTINCT date_trunc('month', ts)) AS months, count(*) AS n FROM events),
c AS (SELECT 'event_id' AS id_column, count(DISTINCT event_id) AS ids FROM events UNION ALL
  SELECT 'user_id', count(DISTINCT user_id) FROM events UNION ALL
  SELECT 'value', count(DISTINCT value) FROM events UNION ALL
  SELECT 'flag', count(DISTINCT value > 50) FROM events)
SELECT months, ids, 'ts' AS date_column, id_column, 'flag' AS target_column FROM c, s
WHERE ids > 1 AND ids < n * 0.95 ORDER BY abs(ids - greatest(1, round(n / greatest(1, months)))), id_column LIMIT 1""",
)
def roles_detected(spark, d):
    """Date by type and name, target by distinct 0/1 values, id by distinct count nearest rows per month."""
    from tessella.operators.features import detect_roles

    ev = table(spark, d, "events").select("event_id", "ts", "user_id", "value").withColumn(
        "flag", (F.col("value") > 50).cast("int")
    )
    return detect_roles(ev)


@query(
    "string_functions",
    """SELECT c_custkey, lower(trim(c_name)) AS low, replace(c_name, '#', '-') AS swapped, starts_with(c_name, 'Cust') AS starts,
  ends_with(c_name, '7') AS ends_seven, contains(c_name, '#0') AS has_zero, split_part(c_name, '#', 2) AS tail,
  lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS padded, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS titled FROM customer""",
)
def string_functions(spark, d):
    """J1."""
    n = F.col("c_name")
    return table(spark, d, "customer").select(
        "c_custkey", F.lower(F.trim(n)).alias("low"), F.replace(n, F.lit("#"), F.lit("-")).alias("swapped"),
        n.startswith("Cust").alias("starts"), n.endswith("7").alias("ends_seven"), n.contains("#0").alias("has_zero"),
        F.split(n, "#")[1].alias("tail"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0").alias("padded"),
        F.initcap(F.lower("c_mktsegment")).alias("titled"),
    )


@query(
    "regex_functions",
    """SELECT doc_id, regexp_matches(text, '(?i)the') AS has_the, regexp_matches(text, '^[A-Z][a-z]+ ') AS starts_word,
  regexp_extract(source, '^src(\\d+)$', 1) AS source_no, length(regexp_replace(text, '[^\\p{L}\\p{N}_]', '', 'g'))::INTEGER AS word_chars,
  regexp_full_match(lang, '[a-z]{2}') AS two_letters FROM documents""",
)
def regex_functions(spark, d):
    """Search, anchored, capture, Unicode substitution, full match."""
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", t.rlike("(?i)the").alias("has_the"), t.rlike("^[A-Z][a-z]+ ").alias("starts_word"),
        F.regexp_extract("source", r"^src(\d+)$", 1).alias("source_no"),
        F.length(F.regexp_replace(t, r"[^\p{L}\p{N}_]", "")).alias("word_chars"),
        F.col("lang").rlike("^[a-z]{2}$").alias("two_letters"),
    )


@query(
    "date_functions",
    """SELECT o_orderkey, CAST(strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS DATE) AS parsed,
  last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)) AS quarter_end,
  CAST(CAST(o_orderdate AS DATE) + INTERVAL 6 MONTH AS DATE) AS plus_six,
  CAST(datediff('month', DATE '1995-01-01', CAST(date_trunc('month', o_orderdate) AS DATE)) AS INTEGER) AS month_no FROM orders""",
)
def date_functions(spark, d):
    """J3."""
    day = F.col("o_orderdate").cast("date")
    label = F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))
    return table(spark, d, "orders").select(
        "o_orderkey", F.to_date(F.date_format(day, "dd/MM/yyyy"), "dd/MM/yyyy").alias("parsed"),
        PD.quarter_end(label).alias("quarter_end"), F.add_months(day, 6).alias("plus_six"),
        F.months_between(F.trunc(day, "month"), F.lit("1995-01-01").cast("date")).cast("int").alias("month_no"),
    )


@query(
    "math_functions",
    """SELECT c_custkey, round(ln(nullif(abs(c_acctbal), 0)), 6) AS log_abs, round(ln(1 + abs(c_acctbal)), 6) AS log1p_abs,
  round_even(c_custkey / 4.0, 0)::DOUBLE AS half_even, round(c_acctbal / nullif(c_nationkey, 0), 6) AS per_nation,
  isinf(c_acctbal) AS infinite FROM customer""",
)
def math_functions(spark, d):
    """J4."""
    b = F.col("c_acctbal")
    return table(spark, d, "customer").select(
        "c_custkey", r(N.log_size(F.abs(b))).alias("log_abs"), r(F.log1p(F.abs(b))).alias("log1p_abs"),
        F.bround(F.col("c_custkey") / 4.0, 0).cast("double").alias("half_even"),
        r(N.safe_ratio(b, F.col("c_nationkey").cast("double"))).alias("per_nation"), N.is_infinite(b).alias("infinite"),
    )


@query(
    "null_functions",
    """SELECT event_id, nullif(event_type, 'error') AS kind, coalesce(nullif(event_type, 'error'), 'none') AS kind_filled,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, (event_type = 'error')::INT + (value > 100)::INT AS empties FROM events""",
)
def null_functions(spark, d):
    """Sentinel to null, coalesce, try_cast of JSON text, null counts per row."""
    kind = F.nullif(F.col("event_type"), F.lit("error"))
    big = F.when(F.col("value") <= 100, F.col("value"))
    return table(spark, d, "events").select(
        "event_id", kind.alias("kind"), F.coalesce(kind, F.lit("none")).alias("kind_filled"),
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
        (kind.isNull().cast("int") + big.isNull().cast("int")).alias("empties"),
    )


@query(
    "any_and_all_columns",
    f"""WITH {SUPPLIER_MONTHS} SELECT entity, period, coalesce(returned > 50000, FALSE) OR coalesce(tax > 10000, FALSE) AS any_large,
  returned IS NOT NULL AND tax IS NOT NULL AS all_known FROM supplier_months""",
)
def any_and_all_columns(spark, d):
    """J6."""
    cols = [F.col("returned"), F.col("tax")]
    big = N.any_above([F.col("returned")], 50000) | N.any_above([F.col("tax")], 10000)
    return supplier_months(spark, d).select("entity", "period", big.alias("any_large"), N.all_present(cols).alias("all_known"))


@query(
    "json_documents",
    """SELECT c_nationkey, count(*) AS customers, min(c_custkey) AS first_customer FROM customer GROUP BY 1""",
)
def json_documents(spark, d):
    """Rows to JSON text and back."""
    per = table(spark, d, "customer").groupBy("c_nationkey").agg(
        F.count("*").alias("customers"), F.min("c_custkey").alias("first_customer")
    )
    packed = per.select("c_nationkey", F.to_json(F.struct("customers", "first_customer")).alias("doc"))
    back = F.from_json("doc", "customers long, first_customer long")
    return packed.select("c_nationkey", back.alias("j")).select("c_nationkey", "j.customers", "j.first_customer")


@query(
    "name_intersection",
    "SELECT p_name FROM part WHERE p_size <= 5 INTERSECT SELECT p_name FROM part WHERE p_size >= 48",
)
def name_intersection(spark, d):
    """Requested names that are also available."""
    p = table(spark, d, "part")
    asked = p.filter("p_size <= 5").select("p_name")
    return asked.intersect(p.filter("p_size >= 48").select("p_name"))


@query(
    "stacked_with_different_columns",
    """SELECT 'orders' AS kind, o_orderkey AS id, o_totalprice AS amount, NULL::VARCHAR AS segment FROM orders
UNION ALL SELECT 'customer', c_custkey, NULL, c_mktsegment FROM customer""",
)
def stacked_with_different_columns(spark, d):
    """Union by name with missing columns."""
    o = table(spark, d, "orders").select(F.lit("orders").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return o.unionByName(c, allowMissingColumns=True)


@query("distinct_pairs", "SELECT DISTINCT p_brand, p_type FROM part")
def distinct_pairs(spark, d):
    """I4: distinct pairs for a lookup."""
    return table(spark, d, "part").select("p_brand", "p_type").dropDuplicates()
