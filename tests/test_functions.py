import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessella.functions import numeric as N
from tessella.functions import periods as P
from tessella.functions import text as T


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_clean_numeric(spark):
    raw = ["1,234.5", "−7", "-", "", "1d", "abc", " 12 ", "–3", "—4", "nan", "None", "1e3", "1_000", None]
    got = column(spark, raw, T.clean_numeric)
    assert got == [1234.5, -7, None, None, None, None, 12, -3, -4, None, None, 1000, None, None]


def test_clean_percent(spark):
    assert column(spark, ["1.5%", "−2 %", "%"], lambda c: T.clean_numeric(c, True)) == [1.5, -2, None]


def test_noise(spark):
    raw = ["ВСЬОГО", "Total assets", "source: x", "* n", "---", "  ", "nan", "2020-01-01 x", "Alpha", None]
    assert column(spark, raw, T.is_noise) == [True] * 7 + [False, False, True]
    assert column(spark, raw, lambda c: T.is_noise(c, True))[7] is True


def test_names(spark):
    assert column(spark, [" Total  assets (USD) ", "Активи — всього", "a__b."], T.normalize_name) == [
        "total_assets_usd", "активи_всього", "a_b."]
    assert T.normalize_header(" Total  assets (USD) ") == "total_assets_usd"
    assert column(spark, ["**A   b *"], T.clean_name) == ["A b"]
    assert column(spark, ["JSС Вanк"], T.fold_homoglyphs) == ["JSC Banк"]
    assert column(spark, ["b-A  c"], T.token_key) == ["a b c"]


def test_period_labels(spark):
    assert column(spark, ["2016Q4 [YR2016Q4]", "2019Q1", "x"], P.quarter_end) == [
        dt.date(2016, 12, 31), dt.date(2019, 3, 31), None]
    assert column(spark, ["2016-M01", "2016-M13"], P.month_from_label) == [dt.date(2016, 1, 1), None]
    assert column(spark, ["2016", "x16"], P.year_from_label) == [dt.date(2016, 1, 1), None]
    assert column(spark, ["aggregation_2023-02-01_eng.xlsx", "a_202302.xlsx", "none"], P.period_from_name) == [
        dt.date(2023, 2, 1), dt.date(2023, 2, 1), None]


def test_ratio_guards(spark):
    df = spark.createDataFrame([(1.0, 0.0, None, None), (1.0, 4.0, 1.0, None)], "a double, b double, c double, d double")
    rows = df.select(
        N.safe_ratio(F.col("a"), F.col("b")),
        N.sum_ratio([F.col("c"), F.col("d")], F.lit(4.0)),
        N.clip(F.col("d"), 0.0, 1.0),
        N.any_above([F.col("c"), F.col("d")], 0.5),
        N.log_size(F.col("b")),
    ).collect()
    assert rows[0][:4] == (None, 0.0, None, False) and rows[0][4] is None
    assert rows[1][:4] == (0.25, 0.25, None, True)
    assert rows[1][4] == pytest.approx(1.386294361)
