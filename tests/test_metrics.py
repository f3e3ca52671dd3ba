import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import features as FE
from tessella.operators import metrics as M
from tessella.operators import quantiles as Q
from tessella.operators import ranking as R


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0), (0.5, 0)], "p double, y int")


def random_scores(n, seed, ties):
    rng = random.Random(seed)
    return [(i, round(rng.random(), ties), int(rng.random() < 0.2), rng.choice("ab")) for i in range(n)]


def brute(rows):
    pos, neg = [p for _, p, y, _ in rows if y], [p for _, p, y, _ in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap = last = 0.0
    for t in sorted({p for _, p, _, _ in rows}, reverse=True):
        tp = sum(p >= t for p in pos)
        fp = sum(p >= t for p in neg)
        ap += (tp / len(pos) - last) * tp / (tp + fp)
        last = tp / len(pos)
    return auc, ap


def test_small_values(small):
    assert M.average_precision(small, "y", "p").first()[0] == pytest.approx(0.833333, abs=1e-6)
    assert M.roc_auc(small, "y", "p").first()[0] == pytest.approx(0.833333, abs=1e-6)
    assert M.brier(small, "y", "p").first()[0] == pytest.approx(0.27)
    r = M.threshold_precision_floor(small, "y", "p", 0.7).first()
    assert (r.feasible, r.threshold, r.precision, r.recall) == (True, 0.9, 1.0, 0.5)


def test_against_brute_force_with_ties(spark):
    rows = random_scores(400, 3, 2)
    df = spark.createDataFrame(rows, "id int, p double, y int, g string")
    r = M.ranking_metrics(df, "y", "p").first()
    auc, ap = brute(rows)
    assert r.roc_auc == pytest.approx(auc) and r.average_precision == pytest.approx(ap)
    for g in M.ranking_metrics(df, "y", "p", ["g"]).collect():
        auc, ap = brute([x for x in rows if x[3] == g.g])
        assert g.roc_auc == pytest.approx(auc) and g.average_precision == pytest.approx(ap)


def test_running_totals_with_a_dominant_value(spark):
    rows = [(0.5, 1000)] + [(i / 977, 1) for i in range(977)]
    df = spark.createDataFrame(rows, "s double, n long").groupBy("s").agg(F.sum("n").alias("n"))
    got = Q.ordered_totals(df, "s", ["n"]).orderBy(F.desc("s")).collect()
    run = 0
    for r in got:
        run += r.n
        assert r.run_n == run and r.all_n == 1977


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=501), rng.integers(0, 5, size=501).astype(float)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    got = {(r.column_name, r.prob): r.value for r in Q.percentiles(df, ["a", "b"], probs).collect()}
    for p in probs:
        assert got[("a", p)] == pytest.approx(np.quantile(a, p))
        assert got[("b", p)] == pytest.approx(np.quantile(b, p))


def test_percentile_spot_value_and_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "v double")
    assert Q.percentiles(df, ["v"], [0.25]).first().value == 1.75
    filled = FE.apply_impute(df, FE.fit_impute(df, ["v"]), ["v"]).collect()
    assert sorted(r.v for r in filled) == [1.0, 2.0, 2.5, 3.0, 10.0]


def test_top_k_capture(spark):
    df = spark.createDataFrame([("m1", 1, 0.9, 1), ("m1", 2, 0.1, 0), ("m2", 3, 0.9, 0), ("m2", 4, 0.2, 1)], "m string, id int, p double, y int")
    overall = R.topk_capture_overall(R.topk_capture(df, "m", "y", "p", "id", [1])).first()
    assert (overall.recall, overall.precision, overall.alerts) == (0.5, 0.5, 2)


def test_top_percent_splits_ties_exactly(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0.1, 0.5, 0.5, 0.5, 0.9]), int(rng.random() < 0.3)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, p double, y int")
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    got = {r.percent: r for r in R.top_percent(df, [0.05, 0.25, 0.5], "p", "y", "id").collect()}
    for pct in (0.05, 0.25, 0.5):
        k = max(1, round(pct * 300))
        tp = sum(r[2] for r in order[:k])
        assert got[pct].k == k
        assert got[pct].precision == pytest.approx(tp / k)
        assert got[pct].recall == pytest.approx(tp / sum(r[2] for r in rows))
    picked = {r.id for r in R.top_percent_rows(df, 0.25, "p", "id").collect()}
    assert picked == {r[0] for r in order[:75]}


def test_large_k_ranking_in_one_hot_group(spark):
    df = spark.range(5000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 5003).alias("v"), "id")
    got = R.rank_in_group(df, ["g"], [F.desc("v"), F.asc("id")], 1500)
    want = sorted(((i * 7919 % 5003, i) for i in range(5000)), key=lambda t: (-t[0], t[1]))[:1500]
    assert [(r.v, r.id) for r in got.orderBy("rank").collect()] == want


def test_downsampling_is_exact_and_repeatable(spark):
    df = spark.range(2000).select("id", (F.col("id") % 50 == 0).cast("int").alias("y"))
    a = {r.id for r in FE.downsample_negatives(df, "y", ["id"], 7, 1).collect()}
    b = {r.id for r in FE.downsample_negatives(df.repartition(7), "y", ["id"], 7, 1).collect()}
    c = {r.id for r in FE.downsample_negatives(df, "y", ["id"], 7, 2).collect()}
    assert a == b and a != c and len(a) == 40 + 280
    assert len(FE.downsample_negatives(df, "y", ["id"], 1000, 1).collect()) == 2000


def test_fbeta_matches_direct_scan(spark):
    rows = random_scores(150, 9, 3)
    df = spark.createDataFrame(rows, "id int, p double, y int, g string")
    best = (0.0, 0.5)
    for t in [0.0, *sorted({p for _, p, _, _ in rows}), 1.0]:
        tp = sum(y for _, p, y, _ in rows if p >= t)
        n = sum(p >= t for _, p, _, _ in rows)
        pr, rc = (tp / n if n else 0.0), tp / sum(y for _, _, y, _ in rows)
        f = 5 * pr * rc / (4 * pr + rc) if pr + rc else 0.0
        if f > best[0] + 1e-12:
            best = (f, t)
    r = M.threshold_fbeta(df, "y", "p", 2.0).first()
    assert r.f_beta == pytest.approx(best[0]) and r.threshold == best[1]


def test_mutual_information_of_a_copy(spark):
    df = spark.range(100).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2).cast("double").alias("x"))
    assert M.mutual_information(df, ["x"], "y").first()[1] == pytest.approx(math.log(2))
