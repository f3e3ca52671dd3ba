"""Operators on decoded sheets: ``(file, sheet, row, col, value)`` cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import any_pattern, is_noise, token_key
from tessella.operators.quality import AGGREGATE_WORDS
from tessella.session import materialize

# Sheet-name patterns per statement type, in rank order.
SHEET_PATTERNS = {
    "assets": [r"^assets?$", r"^total[ _]+assets?$"],
    "liabilities": [r"^liabilities?$", r"^total[ _]+liab"],
    "equity": [r"^equity$", r"^shareholders?[ _]+equity$", r"^total[ _]+equity$"],
    "financial_results": [
        r"^financial[ _]+results?_?$",
        r"^fin[ _]*results?_?$",
        r"^financial.*res_?$",
    ],
}

# Clean labels used when no pattern matches.
SHEET_LABELS = {
    "assets": "assets",
    "liabilities": "liabilities",
    "equity": "equity",
    "financial_results": "financial results",
}

# Sheet categories in two languages, first match wins.
CATEGORY_PATTERNS = {
    "assets": [r"assets?", r"активи"],
    "liabilities": [r"liabilit", r"зобов", r"пасив"],
    "equity": [r"equity", r"capital", r"капітал"],
    "financial_results": [r"financial.*result", r"fin.*result", r"прибут", r"збито"],
}

# Sheet-name endings that mark a statement sheet.
VALID_SHEET_PATTERNS = [r"assets?_?$", r"liabilities?_?$", r"equity_?$", r"results?_?$"]

# Header search rows and the row assumed when none qualifies.
HEADER_ROWS = (3, 7)
DEFAULT_HEADER_ROW = 4


def choose_sheet(sheets: DataFrame, min_similarity: float = 0.8) -> DataFrame:
    """One sheet per (file, type) from ``(file, sheet, ord)``.

    Sheets in national currency are out.  The lowest pattern rank wins, then
    sheet order; without a pattern match the sheet closest to the type's label
    is taken if it is similar enough.
    """
    usd = sheets.filter(~F.col("sheet").endswith("_NC"))
    per_type = []
    for kind, patterns in SHEET_PATTERNS.items():
        rank = F.lit(None).cast("int")
        for i in reversed(range(len(patterns))):
            rank = F.when(F.col("sheet").rlike("(?iu)" + patterns[i]), i).otherwise(rank)
        label, key = F.lit(SHEET_LABELS[kind]), token_key(F.col("sheet"))
        longer = F.greatest(F.length(key), F.length(label))
        near = F.lit(1.0) - F.levenshtein(key, label) / longer
        per_type.append(F.struct(F.lit(kind).alias("data_type"), rank.alias("rank"), near.alias("near")))
    options = usd.withColumn("o", F.explode(F.array(*per_type))).select("file", "sheet", "ord", "o.*")
    options = options.filter(F.col("rank").isNotNull() | (F.col("near") >= min_similarity))
    closeness = F.when(F.col("rank").isNull(), F.col("near"))
    w = Window.partitionBy("file", "data_type").orderBy(
        F.asc_nulls_last("rank"), closeness.desc(), "ord"
    )
    return (
        options.withColumn("_rn", F.row_number().over(w))
        .filter("_rn = 1")
        .select(
            "file",
            "data_type",
            "sheet",
            F.when(F.col("rank").isNotNull(), "pattern").otherwise("fuzzy").alias("via"),
        )
    )


def detect_header(cells: DataFrame) -> DataFrame:
    """Header row per (file, sheet).

    The first of the search rows with a cell containing "bank" and at least
    half of its cells being non-numeric text; otherwise the default.
    """
    text = F.lower(F.trim("value"))
    filled = F.col("value").isNotNull()
    wordy = filled & (text != "") & ~text.rlike(r"^\d+$") & (text != "nan")
    # All rows outside the search range share one slot, so one pass serves both
    # the search and the list of sheets.
    slot = F.when(F.col("row").between(*HEADER_ROWS), F.col("row")).alias("slot")
    per_row = cells.groupBy("file", "sheet", slot).agg(
        F.count(F.when(filled, 1)).alias("n"),
        F.count(F.when(wordy, 1)).alias("words"),
        F.max(F.coalesce(text.contains("bank"), F.lit(False))).alias("bank"),
    )
    valid = F.col("bank") & (F.col("words") >= F.col("n") * 0.5)
    return per_row.groupBy("file", "sheet").agg(
        F.coalesce(F.min(F.when(valid, F.col("slot"))), F.lit(DEFAULT_HEADER_ROW)).alias("header_row")
    )


def pack_rows(cells: DataFrame) -> DataFrame:
    """One row per (file, sheet, row) with its cells by column: the width of a
    sheet bounds what a row holds."""
    return cells.groupBy("file", "sheet", "row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("cells"))


def packed_headers(packed: DataFrame) -> DataFrame:
    """Header row per (file, sheet) of packed rows, as ``detect_header`` finds it,
    with its cells; sheets without that row have none."""
    text = F.transform("cells", lambda c: F.lower(F.trim(c["value"])))
    filled = F.filter(text, lambda t: t.isNotNull())
    wordy = F.filter(filled, lambda t: (t != "") & ~t.rlike(r"^\d+$") & (t != "nan"))
    valid = F.exists(filled, lambda t: t.contains("bank")) & (F.size(wordy) >= F.size(filled) * 0.5)
    # At most as many rows per sheet as are searched.
    search = packed.filter(F.col("row").between(*HEADER_ROWS)).withColumn("valid", valid)
    per_sheet = search.groupBy("file", "sheet").agg(
        F.coalesce(F.min(F.when(F.col("valid"), F.col("row"))), F.lit(DEFAULT_HEADER_ROW)).alias("header_row"),
        F.collect_list(F.struct("row", "cells")).alias("rows"),
    )
    named = F.filter("rows", lambda r: r["row"] == F.col("header_row"))
    return per_sheet.select("file", "sheet", "header_row", F.get(named, 0)["cells"].alias("header")).filter("header IS NOT NULL")


def cells_to_records(cells: DataFrame, names: list[str], entity_header: str = "bank") -> DataFrame:
    """Find and promote the header row and reshape the grid to one record per row.

    The grid is read once: packed rows are written, headers come from the first
    rows of those, and each packed row meets its sheet's header.  Output: file,
    sheet, row, ``bank_name`` and one string column per name (of equal headers
    the leftmost counts).  A row without a cell below the header is no record.
    """
    packed = materialize(pack_rows(cells), "grid-rows")
    body = packed.join(packed_headers(packed), ["file", "sheet"]).filter("row > header_row")
    columns = F.transform("header", lambda h: h["col"])
    body = body.filter(F.exists("cells", lambda c: F.array_contains(columns, c["col"])))

    def value(name: str) -> Column:
        at = F.get(F.filter("header", lambda h: F.lower(F.trim(h["value"])) == name), 0)["col"]
        return F.get(F.filter("cells", lambda c: c["col"] == at), 0)["value"]

    return body.select(
        "file", "sheet", "row", F.trim(value(entity_header)).alias("bank_name"), *[value(n.lower()).alias(n.lower()) for n in names]
    )


def drop_noise_rows(df: DataFrame, name: str, dates: bool = False) -> DataFrame:
    return df.filter(~is_noise(F.col(name), dates))


def category(name: Column) -> Column:
    """Statement category of a sheet name, or ``unknown``."""
    out = F.lit("unknown")
    for kind, patterns in reversed(CATEGORY_PATTERNS.items()):
        out = F.when(name.rlike(any_pattern(patterns)), kind).otherwise(out)
    return out


def categorize(sheets: DataFrame) -> DataFrame:
    """Files and sheets per category."""
    named = sheets.select("file", "sheet").distinct().withColumn("category", category(F.col("sheet")))
    per_file = named.groupBy("category", "file").agg(F.count("*").alias("n"))
    return per_file.groupBy("category").agg(
        F.count("*").alias("files"), F.sum("n").alias("sheets")
    )


def sheet_structure(cells: DataFrame) -> DataFrame:
    """Rows, non-empty rows and columns per (file, sheet)."""
    filled = F.col("value").isNotNull() & (F.trim("value") != "")
    per_row = cells.groupBy("file", "sheet", "row").agg(
        F.max(filled).alias("filled"), F.max("col").alias("col")
    )
    return per_row.groupBy("file", "sheet").agg(
        (F.max("row") + 1).alias("n_rows"),
        F.count(F.when(F.col("filled"), 1)).alias("non_empty_rows"),
        (F.max("col") + 1).alias("n_cols"),
    )


def entity_estimate(records: DataFrame, keys: list[str], name: str, low: int = 10, high: int = 200) -> DataFrame:
    """Distinct entity names per file without aggregate rows, with a band."""
    text = F.lower(F.trim(F.col(name)))
    aggregate = text.rlike("(?iu)" + "|".join(AGGREGATE_WORDS))
    real = F.col(name).isNotNull() & (text != "") & ~aggregate
    per_name = records.groupBy(*keys, name).agg(F.max(real).alias("real"))
    n = F.col("entity_count")
    return (
        per_name.groupBy(*keys)
        .agg(F.count(F.when(F.col("real"), 1)).alias("entity_count"))
        .withColumn("band", F.when(n < low, "low").when(n > high, "high").otherwise("ok"))
    )


def file_validity(sheets: DataFrame, estimates: DataFrame) -> DataFrame:
    """A sheet is valid with at least one entity, a file with a valid sheet."""
    joined = sheets.select("file", "sheet").distinct().join(estimates, ["file", "sheet"], "left")
    usd = ~F.col("sheet").contains("_NC")
    valid = usd & (F.coalesce("entity_count", F.lit(0)) > 0)
    known = F.col("sheet").rlike(any_pattern(VALID_SHEET_PATTERNS))
    return joined.groupBy("file").agg(
        F.count("*").alias("sheets"),
        F.count(F.when(valid, 1)).alias("valid_sheets"),
        F.count(F.when(usd & ~known, 1)).alias("unknown_sheets"),
        F.max(valid).alias("is_valid"),
    )


def validity_totals(per_file: DataFrame) -> DataFrame:
    return per_file.agg(
        F.count("*").alias("files"),
        F.count(F.when(F.col("is_valid"), 1)).alias("valid_files"),
        F.count(F.when(~F.col("is_valid"), 1)).alias("invalid_files"),
    )
