"""Top-k, alert budgets, ranking metrics, thresholds and calibration.

Documents carry the labels; the score derives from text length and a language
stands for the reporting period.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import metrics as M
from tessella.operators import ranking as RK
from tessella.plans.base import (
    CUSTOMER_MONTHS,
    SCORED,
    SUPPLIER_MONTHS,
    customer_months,
    query,
    r,
    rounded,
    scored_documents,
    supplier_months,
    table,
)

CURVE = f"""{SCORED}, per AS (SELECT p AS score, CAST(sum(quality) AS BIGINT) AS tp, CAST(sum(1 - quality) AS BIGINT) AS fp FROM scored GROUP BY 1),
curve AS (SELECT *, CAST(sum(tp) OVER w AS BIGINT) AS run_tp, CAST(sum(fp) OVER w AS BIGINT) AS run_fp,
  CAST(sum(tp) OVER () AS BIGINT) AS all_tp, CAST(sum(fp) OVER () AS BIGINT) AS all_fp
  FROM per WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query("top_k_global", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k_global(spark, d):
    """H2."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return RK.top_k(o, 25, [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("head_examples", f"WITH {CUSTOMER_MONTHS} SELECT entity, period, n_orders FROM customer_months WHERE n_orders > 1 ORDER BY n_orders DESC, entity, period LIMIT 5")
def head_examples(spark, d):
    """H7: a few duplicate examples for a report."""
    m = customer_months(spark, d).filter("n_orders > 1").select("entity", "period", "n_orders")
    return RK.top_k(m, 5, [F.desc("n_orders"), F.asc("entity"), F.asc("period")])


@query(
    "watch_list_latest_month",
    f"""WITH {SUPPLIER_MONTHS} SELECT entity, period, price FROM supplier_months WHERE period = (SELECT max(period) FROM supplier_months)
ORDER BY price DESC, entity LIMIT 20""",
)
def watch_list_latest_month(spark, d):
    """H3."""
    m = supplier_months(spark, d).select("entity", "period", "price")
    return RK.watch_list(m, "period", [F.desc("price"), F.asc("entity")], 20)


@query(
    "top_k_per_period",
    f"""WITH {SUPPLIER_MONTHS} SELECT entity, period, price, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY price DESC, entity) AS rank
FROM supplier_months) WHERE rank <= 10""",
)
def top_k_per_period(spark, d):
    """F12, H4."""
    m = supplier_months(spark, d).select("entity", "period", "price")
    return RK.rank_in_group(m, ["period"], [F.desc("price"), F.asc("entity")], 10)


@query(
    "large_k_per_period",
    """SELECT o_orderkey, o_orderstatus, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rank
FROM orders) WHERE rank <= 2000""",
)
def large_k_per_period(spark, d):
    """F12 beyond the optimizer's own group limit: two-step ranking."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return RK.rank_in_group(o, ["o_orderstatus"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2000).drop("o_totalprice")


@query(
    "confident_errors",
    f"""WITH {SCORED} (SELECT doc_id, quality, p FROM scored WHERE quality = 0 ORDER BY p DESC, doc_id LIMIT 50)
UNION ALL (SELECT doc_id, quality, p FROM scored WHERE quality = 1 ORDER BY p DESC, doc_id LIMIT 50)""",
)
def confident_errors(spark, d):
    """H6: most confident false and true positives."""
    s = scored_documents(spark, d).select("doc_id", "quality", "p")
    order = [F.desc("p"), F.asc("doc_id")]
    return RK.top_k(s.filter("quality = 0"), 50, order).unionByName(RK.top_k(s.filter("quality = 1"), 50, order))


@query(
    "top_percent_rows",
    f"""WITH {SCORED}, o AS (SELECT doc_id, p, row_number() OVER (ORDER BY p DESC, doc_id) AS rn, count(*) OVER () AS n FROM scored)
SELECT doc_id, p FROM o WHERE rn <= greatest(1, round_even(0.1 * n, 0))""",
)
def top_percent_rows(spark, d):
    """H5."""
    return RK.top_percent_rows(scored_documents(spark, d).select("doc_id", "p"), 0.1, "p", "doc_id")


@query(
    "precision_at_percent",
    f"""WITH {SCORED}, o AS (SELECT quality, row_number() OVER (ORDER BY p DESC, doc_id) AS rn, count(*) OVER () AS n, sum(quality) OVER () AS pos FROM scored),
k AS (SELECT unnest([0.05, 0.1, 0.2]::DOUBLE[]) AS percent), kk AS (SELECT percent, CAST(greatest(1, round_even(percent * (SELECT count(*) FROM scored), 0)) AS BIGINT) AS k FROM k)
SELECT percent, k, round(sum(quality) FILTER (WHERE rn <= k) / k, 6) AS precision, round(sum(quality) FILTER (WHERE rn <= k) / any_value(pos), 6) AS recall
FROM o, kk GROUP BY percent, k""",
)
def precision_at_percent(spark, d):
    """K26."""
    out = RK.top_percent(scored_documents(spark, d), [0.05, 0.1, 0.2], "p", "quality", "doc_id")
    return out.withColumns({"precision": r("precision"), "recall": r("recall")})


TOPK = f"""{SCORED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY p DESC, doc_id) AS rn FROM scored),
per AS (SELECT lang, CAST(k AS INTEGER) AS k, count(*) FILTER (WHERE rn <= k) AS alerts, CAST(sum(quality) FILTER (WHERE rn <= k) AS BIGINT) AS captured,
  CAST(sum(quality) AS BIGINT) AS positives FROM ranked, (SELECT unnest([5, 10, 20]) AS k) GROUP BY 1, 2)"""


@query("alerts_per_period", f"WITH {TOPK} SELECT * FROM per")
def alerts_per_period(spark, d):
    """K25 per period, all budgets from one ranking."""
    return RK.topk_capture(scored_documents(spark, d), "lang", "quality", "p", "doc_id", [5, 10, 20])


@query(
    "alerts_overall",
    f"""WITH {TOPK} SELECT k, CAST(sum(alerts) AS BIGINT) AS alerts, CAST(sum(captured) AS BIGINT) AS captured, CAST(sum(positives) AS BIGINT) AS positives,
  round(sum(captured) / sum(alerts), 6) AS precision, round(sum(captured) / sum(positives), 6) AS recall FROM per GROUP BY 1""",
)
def alerts_overall(spark, d):
    """K25 overall."""
    return rounded(RK.topk_capture_overall(alerts_per_period(spark, d)))


@query("score_curve", f"WITH {CURVE} SELECT * FROM curve")
def score_curve(spark, d):
    """running counts over descending distinct scores."""
    return M.score_table(scored_documents(spark, d), "quality", "p").select(
        "score", "tp", "fp", "run_tp", "run_fp", "all_tp", "all_fp"
    )


@query("precision_recall_curve", f"WITH {CURVE} SELECT score, round(run_tp / (run_tp + run_fp), 6) AS precision, round(run_tp / all_tp, 6) AS recall FROM curve")
def precision_recall_curve(spark, d):
    """K27."""
    t = M.pr_curve(M.score_table(scored_documents(spark, d), "quality", "p"))
    return t.select("score", r("precision").alias("precision"), r("recall").alias("recall"))


@query("roc_auc", f"WITH {CURVE} SELECT round(sum(fp * (run_tp - tp + tp / 2)) / (max(all_tp) * max(all_fp)), 6) AS roc_auc FROM curve")
def roc_auc(spark, d):
    """K19."""
    return rounded(M.roc_auc(scored_documents(spark, d), "quality", "p"))


@query("roc_auc_single_class", "SELECT NULL::DOUBLE AS roc_auc")
def roc_auc_single_class(spark, d):
    """Null when only one class occurs."""
    return M.roc_auc(scored_documents(spark, d).filter("quality = 1"), "quality", "p")


@query("average_precision", f"WITH {CURVE} SELECT round(sum(tp / all_tp * run_tp / (run_tp + run_fp)), 6) AS average_precision FROM curve")
def average_precision(spark, d):
    """K20."""
    return rounded(M.average_precision(scored_documents(spark, d), "quality", "p"))


@query("brier_score", f"WITH {SCORED} SELECT round(avg((p - quality) * (p - quality)), 6) AS brier FROM scored")
def brier_score(spark, d):
    """K21."""
    return rounded(M.brier(scored_documents(spark, d), "quality", "p"))


@query(
    "metrics_per_group",
    f"""WITH {SCORED}, per AS (SELECT lang, p, sum(quality) AS tp, sum(1 - quality) AS fp FROM scored GROUP BY 1, 2),
c AS (SELECT *, sum(tp) OVER w AS rt, sum(fp) OVER w AS rf, sum(tp) OVER (PARTITION BY lang) AS pos, sum(fp) OVER (PARTITION BY lang) AS neg
  FROM per WINDOW w AS (PARTITION BY lang ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
b AS (SELECT lang, avg((p - quality) * (p - quality)) AS brier FROM scored GROUP BY 1)
SELECT lang, CAST(max(pos) AS BIGINT) AS positives, CAST(max(neg) AS BIGINT) AS negatives, round(sum(fp * (rt - tp + tp / 2)) / nullif(max(pos) * max(neg), 0), 6) AS roc_auc,
  round(sum(tp / nullif(pos, 0) * rt / (rt + rf)), 6) AS average_precision, round(any_value(b.brier), 6) AS brier FROM c JOIN b USING (lang) GROUP BY lang""",
)
def metrics_per_group(spark, d):
    """Metrics per fold-like group in one pass."""
    return rounded(M.quality_metrics(scored_documents(spark, d), "quality", "p", ["lang"]))


@query(
    "confusion_at_threshold",
    f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (WHERE p >= 0.4 AND quality = 1) AS tp, count(*) FILTER (WHERE p >= 0.4 AND quality = 0) AS fp,
  count(*) FILTER (WHERE p < 0.4 AND quality = 1) AS fn, count(*) FILTER (WHERE p < 0.4 AND quality = 0) AS tn FROM scored)
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM c""",
)
def confusion_at_threshold(spark, d):
    """K22."""
    return rounded(M.confusion(scored_documents(spark, d), "quality", "p", 0.4))


GRID_POINTS = f"""{CURVE},
pts AS (SELECT score AS threshold, run_tp, run_fp, all_tp, all_fp FROM curve
  UNION ALL SELECT 0.0, max(all_tp), max(all_fp), max(all_tp), max(all_fp) FROM curve
  UNION ALL SELECT 1.0, coalesce(max(run_tp) FILTER (WHERE score >= 1), 0), coalesce(max(run_fp) FILTER (WHERE score >= 1), 0), max(all_tp), max(all_fp) FROM curve),
pr AS (SELECT threshold, coalesce(run_tp / nullif(run_tp + run_fp, 0), 0) AS precision, coalesce(run_tp / nullif(all_tp, 0), 0) AS recall,
  run_tp AS tp, run_fp AS fp, all_tp - run_tp AS fn, all_fp - run_fp AS tn FROM pts)"""


def _floor_sql(floor: float) -> str:
    return f"""WITH {GRID_POINTS}, x AS (SELECT *, precision >= {floor} AND recall > 0 AS feasible FROM pr)
SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, feasible, tp, fp, fn, tn FROM x
ORDER BY feasible DESC, CASE WHEN feasible THEN recall ELSE precision END DESC, recall DESC, threshold LIMIT 1"""


@query("threshold_precision_floor", _floor_sql(0.9))
def threshold_precision_floor(spark, d):
    """K23, feasible floor."""
    out = M.threshold_precision_floor(scored_documents(spark, d), "quality", "p", 0.9)
    return out.withColumns({"precision": r("precision"), "recall": r("recall")})


@query("threshold_floor_infeasible", _floor_sql(1.01))
def threshold_floor_infeasible(spark, d):
    """K23, floor out of reach: highest precision, then recall."""
    out = M.threshold_precision_floor(scored_documents(spark, d), "quality", "p", 1.01)
    return out.withColumns({"precision": r("precision"), "recall": r("recall")})


@query(
    "threshold_fbeta",
    f"""WITH {GRID_POINTS}, x AS (SELECT *, coalesce(1.25 * precision * recall / nullif(0.25 * precision + recall, 0), 0) AS f_beta FROM pr)
SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f_beta, 6) AS f_beta, tp, fp, fn, tn FROM x ORDER BY x.f_beta DESC, threshold LIMIT 1""",
)
def threshold_fbeta(spark, d):
    """K24 with beta 0.5."""
    out = M.threshold_fbeta(scored_documents(spark, d), "quality", "p", 0.5)
    return out.withColumns({c: r(c) for c in ("precision", "recall", "f_beta")})


@query(
    "calibration_curve",
    f"""WITH {SCORED} SELECT greatest(CAST(ceil(p * 10) AS INTEGER), 1) AS bin, count(*) AS n, round(avg(p), 6) AS mean_predicted, round(avg(quality), 6) AS event_rate
FROM scored GROUP BY 1""",
)
def calibration_curve(spark, d):
    """K28."""
    return rounded(M.calibration(scored_documents(spark, d), "quality", "p"))


WORDS = """w AS (SELECT l.doc_id, l.toxic AS y, CAST(n_chars AS DOUBLE) AS n_chars, CAST(length(replace(text, ' ', '')) AS DOUBLE) AS solid,
  CAST(CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS DOUBLE) AS english FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def word_features(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang", "text")
    return table(spark, d, "labels").join(docs, "doc_id").select(
        "doc_id", F.col("toxic").alias("y"), F.col("n_chars").cast("double").alias("n_chars"),
        F.length(F.replace("text", F.lit(" "), F.lit(""))).cast("double").alias("solid"),
        (F.col("lang") == "en").cast("double").alias("english"),
    )


def _auc_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, sum(fp * (rt - tp + tp / 2)) / (sum(tp) * sum(fp)) AS auc FROM (
  SELECT *, sum(tp) OVER (ORDER BY v DESC ROWS UNBOUNDED PRECEDING) AS rt FROM (
    SELECT {c} AS v, sum(y) AS tp, sum(1 - y) AS fp FROM w GROUP BY 1))"""


@query(
    "univariate_auc",
    f"""WITH {WORDS}, a AS ({_auc_sql('n_chars')} UNION ALL {_auc_sql('solid')} UNION ALL {_auc_sql('english')})
SELECT feature, round(auc, 6) AS roc_auc, round(greatest(auc, 1 - auc), 6) AS power FROM a""",
)
def univariate_auc(spark, d):
    """K16."""
    return rounded(M.univariate_auc(word_features(spark, d), ["n_chars", "solid", "english"], "y"))


def _mi_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, y, least(CAST(floor(({c} - lo_{c}) / nullif(hi_{c} - lo_{c}, 0) * 10) AS INTEGER), 9) AS bin FROM w, lim"""


@query(
    "mutual_information",
    f"""WITH {WORDS}, lim AS (SELECT {", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in ("n_chars", "solid", "english"))} FROM w),
b AS ({_mi_sql('n_chars')} UNION ALL {_mi_sql('solid')} UNION ALL {_mi_sql('english')}),
c AS (SELECT feature, bin, y, count(*) AS n FROM b GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS na FROM c)
SELECT feature, round(sum(n / na * ln(n * na / (nb * ny))), 6) AS mutual_information FROM t GROUP BY 1""",
)
def mutual_information(spark, d):
    """K17."""
    return rounded(M.mutual_information(word_features(spark, d), ["n_chars", "solid", "english"], "y"))
