"""Entity-resolution queries on supplier, part and customer names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as TX
from tessella.operators import entities as EN
from tessella.operators import quality as QA
from tessella.plans.base import query, r, rounded, table

# Shipments whose supplier name comes in variants; some rows are no suppliers.
RAW = """raw AS (
  SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day, l_quantity,
    CASE (l_orderkey + l_linenumber) % 7 WHEN 0 THEN upper(s_name) || ' JSC' WHEN 1 THEN s_name || '**'
      WHEN 2 THEN '  ' || s_name || '   x' WHEN 3 THEN 'State-owned banks' WHEN 4 THEN 'Total' ELSE s_name END AS raw_name
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
dict AS (
  SELECT upper(s_name) || ' JSC' AS variant, s_name AS canonical FROM supplier WHERE s_suppkey % 3 <> 0
  UNION ALL SELECT s_name || '**', CASE WHEN s_suppkey % 2 = 0 THEN s_name END FROM supplier WHERE s_suppkey % 5 = 0),
resolved AS (
  SELECT r.*, CASE WHEN trim(raw_name) IN ('State-owned banks', 'Total') THEN 'removed'
      WHEN d.variant IS NOT NULL AND d.canonical IS NULL THEN 'removed'
      WHEN d.variant IS NOT NULL THEN 'mapped' ELSE 'unmapped' END AS name_status,
    CASE WHEN trim(raw_name) IN ('State-owned banks', 'Total') THEN NULL
      WHEN d.variant IS NOT NULL THEN d.canonical
      ELSE trim(regexp_replace(regexp_replace(trim(raw_name), '\\*+', '', 'g'), '\\s+', ' ', 'g')) END AS canonical
  FROM raw r LEFT JOIN dict d ON d.variant = trim(r.raw_name))"""


def raw_shipments(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity")
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    k, n = (F.col("l_orderkey") + F.col("l_linenumber")) % 7, F.col("s_name")
    name = (
        F.when(k == 0, F.concat(F.upper(n), F.lit(" JSC")))
        .when(k == 1, F.concat(n, F.lit("**")))
        .when(k == 2, F.concat(F.lit("  "), n, F.lit("   x")))
        .when(k == 3, "State-owned banks")
        .when(k == 4, "Total")
        .otherwise(n)
    )
    return li.join(s, li.l_suppkey == s.s_suppkey).select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("day"), "l_quantity", name.alias("raw_name")
    )


def name_dictionary(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    n, k = F.col("s_name"), F.col("s_suppkey")
    a = s.filter(k % 3 != 0).select(F.concat(F.upper(n), F.lit(" JSC")).alias("variant"), n.alias("canonical"))
    b = s.filter(k % 5 == 0).select(F.concat(n, F.lit("**")).alias("variant"), F.when(k % 2 == 0, n).alias("canonical"))
    return a.unionByName(b)


def resolved(spark, d):
    return EN.canonicalize(raw_shipments(spark, d), "raw_name", name_dictionary(spark, d))


@query(
    "canonical_names",
    f"WITH {RAW} SELECT l_orderkey, l_linenumber, day, l_quantity, raw_name, name_status, canonical FROM resolved",
)
def canonical_names(spark, d):
    """C1, C2."""
    return resolved(spark, d)


@query(
    "dictionary_last_entry_wins",
    """SELECT p_name AS variant, arg_max(p_brand || '/' || p_type, p_partkey) AS canonical FROM part GROUP BY 1""",
)
def dictionary_last_entry_wins(spark, d):
    """Repeated dictionary keys, the later entry wins."""
    p = table(spark, d, "part").select(
        F.col("p_name").alias("variant"), F.concat_ws("/", "p_brand", "p_type").alias("canonical"), "p_partkey"
    )
    return EN.mapping_last_wins(p, "p_partkey")


@query("cleaned_names", f"WITH {RAW} SELECT DISTINCT raw_name, trim(regexp_replace(regexp_replace(raw_name, '\\*+', '', 'g'), '\\s+', ' ', 'g')) AS name FROM raw")
def cleaned_names(spark, d):
    """C2."""
    return raw_shipments(spark, d).select("raw_name").distinct().withColumn("name", TX.clean_name(F.col("raw_name")))


@query("aggregates_removed", f"WITH {RAW} SELECT raw_name, count(*) AS n FROM raw WHERE raw_name <> 'State-owned banks' GROUP BY 1")
def aggregates_removed(spark, d):
    """C3."""
    return EN.drop_aggregates(raw_shipments(spark, d), "raw_name").groupBy("raw_name").agg(F.count("*").alias("n"))


@query(
    "canonicalization_statistics",
    f"""WITH {RAW} SELECT count(DISTINCT trim(raw_name)) AS original_entities, count(DISTINCT canonical) AS final_entities,
  count(*) AS original_rows, count(canonical) AS final_rows, count(*) - count(canonical) AS rows_removed,
  count(*) FILTER (WHERE canonical IS NULL OR canonical <> trim(raw_name)) AS names_changed,
  count(DISTINCT trim(raw_name)) - count(DISTINCT canonical) AS entities_consolidated FROM resolved""",
)
def canonicalization_statistics(spark, d):
    """C4."""
    return EN.canon_stats(resolved(spark, d), "raw_name")


# Customers reporting under two names: the older name fills only months the
# newer one lacks.
VARIANTS = """named AS (
  SELECT CASE WHEN o_orderstatus = 'F' THEN 'JSC ' || c_name ELSE c_name END AS name,
    CAST(date_trunc('month', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS amount,
    round(sum(CASE WHEN o_orderpriority < '3' THEN o_totalprice END), 2) AS urgent
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"""


def named_months(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_name")
    joined = o.join(c, o.o_custkey == c.c_custkey)
    name = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("JSC "), "c_name")).otherwise(F.col("c_name"))
    return joined.groupBy(name.alias("name"), F.trunc("o_orderdate", "month").alias("period")).agg(
        r(F.sum("o_totalprice"), 2).alias("amount"),
        r(F.sum(F.when(F.col("o_orderpriority") < "3", F.col("o_totalprice"))), 2).alias("urgent"),
    )


def variant_groups(spark, d):
    c = table(spark, d, "customer").select("c_name")
    return c.select(F.concat(F.lit("JSC "), "c_name").alias("variant"), F.col("c_name").alias("canonical"))


CONSOLIDATED = (
    VARIANTS
    + """,
folded AS (SELECT regexp_replace(name, '^JSC ', '') AS name, name AS raw, period, amount, urgent FROM named),
consolidated AS (SELECT name, period, amount, urgent FROM (SELECT *, row_number() OVER (PARTITION BY name, period
  ORDER BY (raw = name)::INT DESC, (amount IS NOT NULL)::INT + (urgent IS NOT NULL)::INT DESC, raw) AS rn FROM folded) WHERE rn = 1)"""
)


@query("consolidated_variants", f"WITH {CONSOLIDATED} SELECT * FROM consolidated")
def consolidated_variants(spark, d):
    """Variants fill only the periods the canonical entity lacks."""
    return EN.consolidate(named_months(spark, d), "name", "period", variant_groups(spark, d), ["amount", "urgent"])


@query(
    "problem_entities",
    f"""WITH {VARIANTS}, per AS (SELECT CASE WHEN length(name) % 2 = 1 THEN name ELSE right(name, 3) END AS name FROM named),
g AS (SELECT name, count(*)::BIGINT AS present_periods FROM per GROUP BY 1)
SELECT name, present_periods, concat_ws(',', CASE WHEN name LIKE 'JSC %' THEN 'legal_form_prefix' END,
  CASE WHEN length(name) <= 3 THEN 'short_or_numeric' END, CASE WHEN present_periods < 3 THEN 'few_periods' END,
  CASE WHEN name LIKE 'JSC %' THEN 'legal_form_inside' END) AS reasons FROM g
WHERE name LIKE 'JSC %' OR length(name) <= 3 OR present_periods < 3""",
)
def problem_entities(spark, d):
    """C7."""
    n = F.col("name")
    odd = named_months(spark, d).select(F.when(F.length(n) % 2 == 1, n).otherwise(F.right(n, F.lit(3))).alias("name"))
    out = EN.problem_entities(odd.withColumn("present", F.lit(1)), "name", "present")
    return out.withColumn("reasons", F.array_join("reasons", ","))


@query(
    "problem_entities_removed",
    f"""WITH {VARIANTS}, g AS (SELECT name FROM named GROUP BY 1 HAVING name NOT LIKE 'JSC %' AND count(*) >= 3)
SELECT n.name, n.period, n.amount FROM named n JOIN g USING (name)""",
)
def problem_entities_removed(spark, d):
    """Anti join of the flagged entities."""
    m = named_months(spark, d)
    bad = EN.problem_entities(m.withColumn("present", F.lit(1)), "name", "present")
    return EN.drop_problem_entities(m, "name", bad).select("name", "period", "amount")


@query(
    "fuzzy_part_names",
    """WITH dict AS (SELECT DISTINCT p_name FROM part),
typos AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN split_part(p_name, ' ', 2) || '  ' || split_part(p_name, ' ', 1)
    WHEN 2 THEN substr(p_name, 1, 3) || substr(p_name, 5) ELSE replace(p_name, 'e', 'ee') || 's' END AS name FROM part),
keyed AS (SELECT name, array_to_string(list_sort(list_filter(regexp_split_to_array(lower(trim(name)), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')), ' ') AS k FROM typos),
dk AS (SELECT k AS rk, min(p_name) AS match FROM (SELECT p_name,
   array_to_string(list_sort(list_filter(regexp_split_to_array(lower(trim(p_name)), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')), ' ') AS k FROM dict) GROUP BY 1),
sim AS (SELECT name, match, rk, 1.0 - levenshtein(k, rk) / greatest(length(k), length(rk)) AS similarity FROM keyed, dk),
best AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY similarity DESC, rk) AS rn FROM sim WHERE similarity >= 0.8)
SELECT name, match, round(similarity, 6) AS similarity FROM best WHERE rn = 1""",
)
def fuzzy_part_names(spark, d):
    """Misspelled part names against the distinct part names."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    words = F.split(n, " ")
    typo = (
        F.when(k == 0, F.upper(n))
        .when(k == 1, F.concat(words[1], F.lit("  "), words[0]))
        .when(k == 2, F.concat(F.substring(n, 1, 3), F.expr("substring(p_name, 5)")))
        .otherwise(F.concat(F.replace(n, F.lit("e"), F.lit("ee")), F.lit("s")))
    )
    return rounded(EN.fuzzy_match(p.select(typo.alias("name")), p.select(n.alias("name")), "name", 0.8))


@query(
    "residual_variant_audit",
    """SELECT count(*) AS entities, count(*) FILTER (WHERE s_suppkey % 10 = 0) AS residual_variants,
  CASE WHEN count(*) > 70 THEN 'above' WHEN count(*) < 60 THEN 'below' ELSE 'in_range' END AS count_status FROM supplier""",
)
def residual_variant_audit(spark, d):
    """C9."""
    s = table(spark, d, "supplier")
    name = F.when(F.col("s_suppkey") % 10 == 0, F.concat(F.col("s_name"), F.lit(" jsb"))).otherwise(F.col("s_name"))
    return EN.audit_entities(s.select(name.alias("name")), "name", 60, 70)


@query("homoglyphs_folded", "SELECT c_custkey, c_name AS name FROM customer")
def homoglyphs_folded(spark, d):
    """Cyrillic look-alikes put into names and folded back."""
    c = table(spark, d, "customer")
    mixed = F.translate("c_name", "Ceo", "Сео")
    return c.select("c_custkey", TX.fold_homoglyphs(mixed).alias("name"))


@query(
    "unmapped_names",
    f"""WITH {RAW} SELECT trim(raw_name) AS entity_name, min(day) AS first_period, max(day) AS last_period, count(*) AS records
FROM raw WHERE trim(raw_name) NOT IN (SELECT trim(variant) FROM dict) GROUP BY 1""",
)
def unmapped_names(spark, d):
    """C11."""
    return EN.unmapped_names(raw_shipments(spark, d), "raw_name", "day", name_dictionary(spark, d))


@query(
    "consolidation_report",
    f"""WITH {CONSOLIDATED} SELECT (SELECT count(DISTINCT name) FROM named WHERE name LIKE 'JSC %') AS mappings_applied,
  (SELECT count(DISTINCT name) FROM named) AS entities_before, (SELECT count(DISTINCT name) FROM consolidated) AS entities_after,
  (SELECT count(*) FROM named) AS rows_before, (SELECT count(*) FROM consolidated) AS rows_after,
  (SELECT count(*) FROM (SELECT 1 FROM named GROUP BY name, period HAVING count(*) > 1)) AS duplicates_before,
  (SELECT count(*) FROM (SELECT 1 FROM consolidated GROUP BY name, period HAVING count(*) > 1)) AS duplicates_after""",
)
def consolidation_report(spark, d):
    """L10."""
    before, groups = named_months(spark, d), variant_groups(spark, d)
    after = EN.consolidate(before, "name", "period", groups, ["amount", "urgent"])
    return QA.consolidation_report(before, after, "name", "period", groups)
