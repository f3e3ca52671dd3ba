import pytest

from tessella.operators import quality as Q
from tessella.session import build_session, materialize, scratch_path, shared_dir
from tessella.sources import cells as C
from tessella.sources import files as F


def grid(spark, rows):
    return spark.createDataFrame(rows, "file string, sheet string, row int, col int, value string")


def test_header_default_and_search(spark):
    rows = [("f", "a", 5, 0, "Bank"), ("f", "a", 5, 1, "Total"), ("f", "a", 6, 0, "Bank x"),
            ("f", "b", 3, 0, "bank"), ("f", "b", 3, 1, "1"), ("f", "b", 3, 2, "2"), ("f", "c", 9, 0, "Bank")]
    got = {r.sheet: r.header_row for r in C.detect_header(grid(spark, rows)).collect()}
    assert got == {"a": 5, "b": 4, "c": 4}  # b has too many digits, c is out of range


def test_cells_to_records_and_noise(spark):
    rows = [("f", "a", 4, 0, "Bank"), ("f", "a", 4, 1, "Total"), ("f", "a", 5, 0, " X "), ("f", "a", 5, 1, "1"),
            ("f", "a", 6, 0, "Total"), ("f", "a", 7, 1, "4")]
    g = grid(spark, rows)
    out = C.drop_noise_rows(C.cells_to_records(g, ["Total"]), "bank_name").collect()
    assert [(r.bank_name, r.total) for r in out] == [("X", "1")]


def test_packed_headers_are_those_of_the_cells(spark):
    import random

    rng = random.Random(1)
    rows = []
    for sheet in range(60):
        for row in range(rng.choice([2, 4, 9])):
            for col in range(rng.randrange(1, 5)):
                rows.append(("f", f"s{sheet}", row, col, rng.choice(["Bank", "Total", "7", "12", " nan ", "", None, "bank of x"])))
    g = grid(spark, rows)
    by_cell = {r.sheet: r.header_row for r in C.detect_header(g).collect()}
    by_row = {r.sheet: r for r in C.packed_headers(C.pack_rows(g)).collect()}
    assert 10 < len(by_row) <= len(by_cell)
    held = {(r[1], r[2]) for r in rows}
    for sheet, head in by_cell.items():
        assert (sheet in by_row) == ((sheet, head) in held)
        if sheet in by_row:
            assert by_row[sheet].header_row == head
            assert [(c["col"], c["value"]) for c in by_row[sheet].header] == [r[3:] for r in rows if r[1:3] == (sheet, head)]


def test_equal_headers_and_rows_beside_the_table(spark):
    rows = [("f", "a", 3, 0, "Bank"), ("f", "a", 3, 1, " total "), ("f", "a", 3, 2, "Total"), ("f", "a", 9, 0, "X"), ("f", "a", 9, 2, "2"),
            ("f", "a", 10, 7, "beside"), ("f", "a", 11, 1, "5"), ("g", "a", 9, 0, "no header")]
    got = C.cells_to_records(grid(spark, rows), ["Total", "Other"]).collect()
    assert sorted((r.row, r.bank_name, r.total, r.other) for r in got) == [(9, "X", None, None), (11, None, "5", None)]


def test_choose_sheet(spark):
    sheets = [("f", "Assets_NC", 0), ("f", "Total assets", 1), ("f", "asset", 2), ("f", "Liabilitis", 3), ("f", "misc", 4)]
    got = {r.data_type: (r.sheet, r.via) for r in C.choose_sheet(
        spark.createDataFrame(sheets, "file string, sheet string, ord int")).collect()}
    assert got == {"assets": ("asset", "pattern"), "liabilities": ("Liabilitis", "fuzzy")}


def test_categories_in_two_languages(spark):
    df = spark.createDataFrame([("f", n) for n in ["АКТИВИ", "Зобов'язання", "Capital", "Fin results", "x"]], "file string, sheet string")
    got = {r.sheet: r.c for r in df.select("sheet", C.category(df.sheet).alias("c")).collect()}
    assert list(got.values()) == ["assets", "liabilities", "equity", "financial_results", "unknown"]


def test_csv_bom_and_lock_files(spark):
    path = scratch_path(spark, "csv")
    spark.createDataFrame([("﻿a,b",), ("1,x",), ("nan,y",)], "v string").coalesce(1).write.text(path)
    assert F.scan_csv(spark, path).columns == ["a", "b"]
    typed = F.scan_csv(spark, path, "a double, b string").collect()
    assert [(r.a, r.b) for r in typed if r.b in "xy"] == [(1.0, "x"), (None, "y")]
    assert F.discover(spark, path, "part-*").count() == 1


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    df = materialize(spark.range(5).toDF("x"), "t")
    assert df.count() == 5
    assert build_session() is not None


def test_schema_drift_twins(spark):
    names = [("s1", "assets_Cash"), ("s1", "assets_Саsh"), ("s1", "equity_x"), ("s2", "other")]
    df = spark.createDataFrame(names, "snapshot string, name string")
    got = {(r.snapshot, r.column_class): (r["columns"], r.twins) for r in Q.schema_drift(df, "snapshot", "name").collect()}
    assert got == {("s1", "assets"): (2, 1), ("s1", "equity"): (1, 0), ("s2", "other"): (1, 0)}


def test_date_validity(spark):
    df = spark.createDataFrame([("2020-01-31",), ("2020-02-30",), (None,), ("x",)], "d string")
    assert tuple(Q.date_validity(df, "d").first()) == (4, 3)


@pytest.mark.parametrize("approximate", [True, False])
def test_distinct_counts(spark, approximate):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "a")], "x int, y string")
    got = {r.column_name: r.distinct_values for r in Q.distinct_counts(df, ["x", "y"], approximate).collect()}
    assert got == {"x": 2, "y": 1}
