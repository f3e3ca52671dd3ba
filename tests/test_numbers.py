"""Numbers that must survive offsets, gaps, repeats and missing values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessella.operators import entities as EN
from tessella.operators import features as FE
from tessella.operators import labels as LB
from tessella.operators import learning as LN
from tessella.operators import metrics as M
from tessella.operators import quality as Q
from tessella.operators import ranking as RK
from tessella.operators import series as S
from tessella.session import clear_scratch, freeze, scratch_path, shared_dir


def test_between_share_does_not_depend_on_an_offset(spark):
    rows = [(e, 10.0 * e + k) for e in range(20) for k in (-1.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "e int, v double").withColumn("far", F.col("v") + 1e9)
    got = {r.column_name: r.between_share for r in Q.between_share(df, "e", ["v", "far"]).collect()}
    assert got["v"] == pytest.approx(3325 / (3325 + 2 / 3), abs=1e-9)
    assert got["far"] == pytest.approx(got["v"], abs=1e-6)


def test_an_all_null_column_is_prepared_as_zero(spark):
    df = spark.createDataFrame([(None, 1), (None, 0)], "x double, y int")
    assert freeze(df, FE.fit_impute(df, ["x"])) is not None
    (ready,) = LN.prepare(df, [df], ["x"])
    assert [r.x for r in ready.collect()] == [0.0, 0.0]


def test_a_repeated_variant_keeps_one_target(spark):
    df = spark.createDataFrame([("Alpha One",)], "n string")
    mapping = spark.createDataFrame([("Alpha One", "A", 1), (" Alpha One", "B", 2), ("Alpha One ", "C", 0)], "variant string, canonical string, at int")
    assert [r.canonical for r in EN.canonicalize(df, "n", mapping, "at").collect()] == ["B"]
    assert [r.canonical for r in EN.canonicalize(df, "n", mapping.drop("at")).collect()] == ["C"]


def test_lookup_names_follow_their_order(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "code string, v double")
    names = spark.createDataFrame([("a", "old", 1), ("a", "new", 2)], "code string, label string, at int")
    got = {r.code: r.label for r in S.rename_from_lookup(df, names, "code", "label", "at").collect()}
    assert got == {"a": "new", "b": "b"}


def test_outer_merge_refuses_clashes(spark):
    a, b = (spark.createDataFrame([(1, 1.0)], "k int, v double") for _ in range(2))
    with pytest.raises(ValueError, match="share"):
        S.outer_merge([a, b], "k")
    twice = spark.createDataFrame([(1, 1.0), (1, 2.0)], "k int, w double")
    with pytest.raises(Exception, match="repeats a value"):
        S.outer_merge([a, twice], "k").collect()


def test_lags_and_windows_follow_the_calendar(spark):
    rows = [(1, dt.date(2020, m, 1), float(m)) for m in (1, 3, 4, 7)]
    df = spark.createDataFrame(rows, "e int, d date, v double")
    out = FE.add_rolling(FE.add_lags(df, "e", "d", ["v"], [1, 2, -3]), "e", "d", ["v"], [3])
    got = [(r.v_lag1, r.v_lag2, r["v_lag-3"], r.v_ma3) for r in out.orderBy("d").collect()]
    assert got == [(None, None, 4.0, 1.0), (None, 1.0, None, 2.0), (3.0, None, 7.0, 3.5), (None, None, None, 7.0)]


def test_missing_scores_are_refused(spark):
    df = spark.createDataFrame([(1, 0.5), (0, None)], "y int, p double")
    with pytest.raises(Exception, match="p is null"):
        M.ranking_metrics(df, "y", "p").collect()


def test_one_plan_ranks_any_k(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.xxhash64("id").alias("v"), "id")
    for k in (1, 7, 1500):
        got = RK.rank_in_group(df, ["g"], [F.desc("v"), F.asc("id")], k)
        text = got._jdf.queryExecution().executedPlan().toString()
        assert text.count("Window [") + text.count("Window(") >= 2 and got.count() == 2 * k


def test_results_do_not_depend_on_the_number_of_ranges(spark):
    df = spark.range(3000).select((F.xxhash64("id") % 500).cast("double").alias("p"), (F.col("id") % 7 == 0).cast("int").alias("y"), "id")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    seen = set()
    try:
        for n in ("3", "300"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            auc = M.ranking_metrics(df, "y", "p").first()["roc_auc"]
            kept = FE.downsample_negatives(df, "y", ["id"], 2, 5).agg(F.count("*"), F.sum("id")).first()
            seen.add((round(auc, 12), *kept))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(seen) == 1


def test_block_folds_validate_every_later_month_once(spark):
    rows = [(e, dt.date(2020 + m // 12, m % 12 + 1, 1)) for e in range(3) for m in range(20)]
    df = spark.createDataFrame(rows, "e int, d date")
    got = LB.block_fold_rows(df, "d", 6, 4)
    validated = got.filter("role = 'validate'").groupBy("e", "d").count()
    assert validated.count() == 3 * 14 and validated.filter("count > 1").count() == 0
    leak = got.filter("role = 'train'").groupBy("fold").agg(F.max("d").alias("t")).join(
        got.filter("role = 'validate'").groupBy("fold").agg(F.min("d").alias("v")), "fold"
    )
    assert leak.count() == 4 and leak.filter("t >= v").count() == 0


def test_scratch_belongs_to_the_application(spark):
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert path.startswith(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/")
    assert scratch_path(spark, "gone") != path and callable(clear_scratch)
