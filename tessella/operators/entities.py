"""Entity resolution: canonical names, duplicates, fuzzy matches, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import clean_name, edit_similarity, is_noise, token_key
from tessella.session import bound, materialize, one_row

# Pseudo-entities that aggregate others.
AGGREGATE_ENTITIES = [
    "Banks owned by foreign bank groups",
    "Privately owned banks",
    "State-owned banks",
    "Insolvent Banks",
    "Insolvent banks",
]

# Legal forms that mark an unresolved name (one has a Cyrillic C).
LEGAL_FORM_PREFIXES = [
    r"^JSC\s+",
    r"^PJSC\s+",
    r"^JSCB\s+",
    r"^CB\s+",
    r"^JSС\s+",
    r"^JSB\s+",
    r"^JOINT\s+STOCK\s+BANK\s+",
    r".*PrJSC.*",
]
LEGAL_FORM_EMBEDDED = [r"PuJSC", r"\bJSC\b", r"\bPJSC\b"]
RESIDUAL_VARIANTS = r"(?iu)JSB|JSCB"


def canonicalize(df: DataFrame, name: str, mapping: DataFrame, order: str | None = None) -> DataFrame:
    """Add ``canonical`` and ``name_status`` from a (variant, canonical) table.

    A repeated variant has one target: the entry latest in ``order``, or, without
    an order, the greatest canonical name.
    A variant mapped to null means "delete the row"; unmapped names fall back
    to cleaning.  The dictionary's size is unknown here, so the join strategy
    is left to the optimizer's own size check.
    """
    entries = mapping.select(
        F.trim("variant").alias("variant"), "canonical", (F.col(order) if order else F.col("canonical")).alias("_order")
    )
    single = mapping_last_wins(entries, "_order")
    marked = single.select(
        F.col("variant").alias("_key"), F.col("canonical").alias("_target"), F.lit(True).alias("_hit")
    )
    text = F.trim(F.col(name))
    joined = df.withColumn("_key", text).join(marked, "_key", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    drop = is_noise(text, dates=True) | text.isin(AGGREGATE_ENTITIES)
    status = (
        F.when(drop, "removed")
        .when(hit & F.col("_target").isNull(), "removed")
        .when(hit, "mapped")
        .otherwise("unmapped")
    )
    target = F.when(hit, F.col("_target")).otherwise(clean_name(text))
    return (
        joined.withColumn("name_status", status)
        .withColumn("canonical", F.when(F.col("name_status") != "removed", target))
        .drop("_key", "_target", "_hit")
    )


def mapping_last_wins(mapping: DataFrame, order: str) -> DataFrame:
    """One target per variant; the entry latest in ``order`` wins."""
    w = Window.partitionBy("variant").orderBy(F.desc_nulls_last(order))
    return mapping.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", order)


def drop_aggregates(df: DataFrame, name: str, names: list[str] | None = None) -> DataFrame:
    return df.filter(~F.col(name).isin(names or AGGREGATE_ENTITIES))


def canon_stats(resolved: DataFrame, name: str) -> DataFrame:
    """Counts before and after canonicalisation, from one pass over names.

    Rows are first counted per (raw, canonical) pair, so the exact distinct
    counts run over names, not over rows.
    """
    raw = F.trim(F.col(name))
    pairs = resolved.groupBy(raw.alias("raw"), "canonical").agg(F.count("*").alias("n"))
    gone = F.col("canonical").isNull()
    changed = gone | (F.col("canonical") != F.col("raw"))
    return pairs.agg(
        F.count_distinct("raw").alias("original_entities"),
        F.count_distinct("canonical").alias("final_entities"),
        F.sum("n").alias("original_rows"),
        F.sum(F.when(~gone, F.col("n")).otherwise(0)).alias("final_rows"),
        F.sum(F.when(gone, F.col("n")).otherwise(0)).alias("rows_removed"),
        F.sum(F.when(changed, F.col("n")).otherwise(0)).alias("names_changed"),
    ).withColumn(
        "entities_consolidated", F.col("original_entities") - F.col("final_entities")
    )


def completeness(cols: list[str]) -> Column:
    """Number of non-null data columns in a row."""
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in cols])


def dedupe_most_complete(
    df: DataFrame, keys: list[str], data_cols: list[str], order: list[Column | str]
) -> DataFrame:
    """Keep the fullest row per key, first in ``order`` on ties.

    The partial group limit keeps a hot key to one row per map task.
    """
    w = Window.partitionBy(*keys).orderBy(completeness(data_cols).desc(), *order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def consolidate(
    df: DataFrame, name: str, period: str, groups: DataFrame, data_cols: list[str]
) -> DataFrame:
    """Fold variants into their canonical entity.

    The canonical entity's own row wins; a variant's row is used only for
    periods the canonical entity lacks (fullest variant first, then by name).
    """
    lookup = groups.select(F.col("variant").alias("_v"), F.col("canonical").alias("_c"))
    joined = df.join(lookup, df[name] == F.col("_v"), "left")
    folded = joined.withColumn("_raw", F.col(name)).withColumn(
        name, F.coalesce("_c", F.col(name))
    )
    own = (F.col("_raw") == F.col(name)).cast("int")
    w = Window.partitionBy(name, period).orderBy(
        own.desc(), completeness(data_cols).desc(), "_raw"
    )
    return (
        folded.withColumn("_rn", F.row_number().over(w))
        .filter("_rn = 1")
        .drop("_rn", "_v", "_c", "_raw")
    )


def problem_entities(df: DataFrame, name: str, present: str, min_periods: int = 3) -> DataFrame:
    """Entities to review, each with the reasons found."""
    per = df.groupBy(name).agg(F.sum(present).alias("present_periods"))
    text = F.trim(F.col(name))
    prefix = "(?iu)" + "|".join(f"(?:{p})" for p in LEGAL_FORM_PREFIXES)
    inside = "(?iu)" + "|".join(f"(?:{p})" for p in LEGAL_FORM_EMBEDDED)
    reasons = F.array_compact(
        F.array(
            F.when(F.col(name).rlike(prefix), "legal_form_prefix"),
            F.when((F.length(text) <= 3) | text.rlike(r"^\d+$"), "short_or_numeric"),
            F.when(F.col("present_periods") < min_periods, "few_periods"),
            F.when(F.col(name).rlike(inside), "legal_form_inside"),
        )
    )
    return per.withColumn("reasons", reasons).filter(F.size("reasons") > 0)


def drop_problem_entities(df: DataFrame, name: str, problems: DataFrame) -> DataFrame:
    return df.join(problems.select(name), name, "left_anti")


def audit_entities(df: DataFrame, name: str, low: int, high: int) -> DataFrame:
    """Residual legal-form variants and whether the entity count is in range."""
    names = df.select(F.col(name).alias("n")).distinct()
    return names.agg(
        F.count("n").alias("entities"),
        F.count(F.when(F.col("n").rlike(RESIDUAL_VARIANTS), 1)).alias("residual_variants"),
    ).withColumn(
        "count_status",
        F.when(F.col("entities") > high, "above").when(F.col("entities") < low, "below").otherwise("in_range"),
    )


def unmapped_names(df: DataFrame, name: str, period: str, mapping: DataFrame) -> DataFrame:
    """Names the dictionary lacks, with first and last period and row count."""
    seen = df.groupBy(F.trim(F.col(name)).alias("entity_name")).agg(
        F.min(period).alias("first_period"),
        F.max(period).alias("last_period"),
        F.count("*").alias("records"),
    )
    known = mapping.select(F.trim("variant").alias("entity_name"))
    return seen.join(known, "entity_name", "left_anti")


# Grams in over one name of this many count as frequent when grams are ranked.
FREQUENT = 100
# Pairs a shared key may give per name that holds it; keys with more are split.
PAIRS_PER_NAME = 16


def _ranked_grams(names: DataFrame, q: int) -> DataFrame:
    """``names`` (side, key) with their q-grams as hashes, rare ones first.

    The i-th occurrence of a gram is a gram of its own, so arrays are sets.  Only
    grams in over one name of FREQUENT are ranked by frequency: at most
    FREQUENT times the grams of an average name, whatever the number of names.
    """
    ends = "\u0002" * (q - 1)
    padded = F.concat(F.lit(ends), F.col("key"), F.lit(ends))
    n = F.char_length("key") + (q - 1)

    def numbered(grams: Column) -> Column:
        return F.transform(
            grams, lambda g, i: F.xxhash64(g, F.size(F.filter(F.slice(grams, 1, i + 1), lambda x: x == g)))
        )

    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(padded, i, F.lit(q)))
    grams = F.transform(F.array(cut), numbered)[0]
    rows = names.select("side", "key", F.char_length("key").alias("len"), grams.alias("grams"))
    total = one_row(rows, n=F.count("*"))["n"]
    often = rows.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("df"))
    often = often.filter(F.col("df") * FREQUENT > total)
    ranks = often.agg(F.map_from_entries(F.collect_list(F.struct("g", "df"))).alias("m")).scalar()
    rank = F.transform(
        "grams", lambda g: F.struct(F.coalesce(F.try_element_at(F.col("_ranks"), g), F.lit(0)).alias("df"), g.alias("g"))
    )
    return bound(rows, "_ranks", ranks).withColumn("grams", F.array_sort(rank)["g"]).drop("_ranks")


def _candidates(grams: DataFrame, edits: int, q: int, threshold: float, name: str) -> DataFrame:
    """(key, rkey) pairs that hold every pair of at most ``edits`` edits and the
    similarity asked for.

    Such names share so many grams (``t``, by either one's length) that the m-th
    they share is among the first ``size - t + m`` of both.  So they meet where
    the first gram they share is a key.  A key that would give more than
    PAIRS_PER_NAME pairs a name is split: its names go on with each later gram as
    a second part of the key, then a third.  Names that must share no more grams than the
    key has meet all others there.  Every other key gives few pairs per name.
    """
    size = F.size("grams")
    t = F.greatest(size - q * edits, F.ceil(F.lit(q - 1) + F.lit(1 - q * (1 - threshold) - 1e-9) * F.col("len")).cast("int"))
    rows = grams.withColumn("t", F.greatest(t, F.lit(1))).withColumn("last", F.lit(0)).withColumn("h", F.lit(0).cast("long"))
    found, m = [], 1
    while True:
        at = F.explode(F.sequence(F.col("last") + 1, F.size("grams") - F.col("t") + m))
        rows = rows.select("side", "key", "len", "grams", "t", "h", at.alias("last"))
        rows = rows.withColumn("h", F.xxhash64("h", F.get("grams", F.col("last") - 1)))
        sides = rows.groupBy("h").agg(F.sum(F.when(F.col("side") == 0, 1)).alias("l"), F.sum("side").alias("r"))
        heavy = materialize(
            sides.filter(F.col("l") * F.col("r") > PAIRS_PER_NAME * (F.col("l") + F.col("r"))).select(F.col("h").alias("hh")), name
        )

        def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
            left = left.filter("side = 0").select("h", "key", "len")
            right = right.filter("side = 1").select("h", F.col("key").alias("rkey"), F.col("len").alias("rlen"))
            return left.join(right, "h").filter(F.abs(F.col("len") - F.col("rlen")) <= edits).select("key", "rkey")

        if heavy.isEmpty():
            found.append(pairs(rows, rows))
            break
        light = rows.join(heavy, F.col("h") == F.col("hh"), "left_anti")
        found.append(pairs(light, light))
        rows = materialize(rows.join(heavy, F.col("h") == F.col("hh"), "left_semi"), name)
        stuck, free = rows.filter(F.col("t") == m), rows.filter(F.col("t") > m)
        found += [pairs(stuck, rows), pairs(free, stuck)]
        rows, m = free, m + 1
    return reduce(DataFrame.unionByName, found).distinct()


def fuzzy_match(left: DataFrame, right: DataFrame, name: str, threshold: float = 0.8) -> DataFrame:
    """Best dictionary name for every name, by similarity of sorted tokens.

    Rows are reduced to distinct token keys first, and keys that match exactly
    are settled by an equi-join.  The rest is searched with a growing number of
    edits: a key is settled once its best match beats whatever more edits could
    give, or once the threshold allows no more, so names with a close match never
    meet distant ones.  Candidates come from an index of rare grams
    (``_candidates``) and the edit distance decides; nothing is lost.  Ties go to the
    smallest dictionary key.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    lk = left.select(F.col(name).alias("name")).distinct().withColumn("key", token_key(F.col("name")))
    rk = (
        right.select(F.col(name).alias("match"))
        .distinct()
        .withColumn("rkey", token_key(F.col("match")))
        .groupBy("rkey")
        .agg(F.min("match").alias("match"))
    )
    exact = lk.join(rk, lk["key"] == rk["rkey"]).select("name", "match", F.lit(1.0).alias("similarity"))
    open_keys = lk.join(rk, lk["key"] == rk["rkey"], "left_anti").select("key").distinct().filter("key != ''")
    q = 2 if threshold >= 0.5 else 1  # below, two names need not share a pair of letters
    names = open_keys.select(F.lit(0).alias("side"), "key").unionByName(
        rk.filter("rkey != ''").select(F.lit(1).alias("side"), F.col("rkey").alias("key"))
    )
    grams = materialize(_ranked_grams(names, q), "fuzzy-grams")
    dictionary, waiting = grams.filter("side = 1"), grams.filter("side = 0")
    most = F.floor(F.lit((1 - threshold) / threshold + 1e-9) * F.col("len"))
    edits, settled = 1, []
    while True:
        limit = waiting.agg(F.max(most)).first()[0]
        if not limit:
            break
        pairs = _candidates(waiting.unionByName(dictionary), edits, q, threshold, "fuzzy-keys")
        near = pairs.filter(F.levenshtein("key", "rkey") <= edits).withColumn("similarity", edit_similarity(F.col("key"), F.col("rkey")))
        near = near.filter(F.col("similarity") >= threshold)
        best = near.groupBy("key").agg(F.min(F.struct((-F.col("similarity")).alias("less"), "rkey")).alias("b"))
        beyond = 1 - F.lit(edits + 1) / (F.col("len") + edits + 1)
        done = (most <= edits) | F.coalesce(-F.col("b.less") > beyond + 1e-12, F.lit(False))
        tried = materialize(waiting.join(best, "key", "left").withColumn("done", done), "fuzzy-tried")
        settled.append(tried.filter("done and b is not null").select("key", "b.rkey", (-F.col("b.less")).alias("similarity")))
        waiting = tried.filter(~F.col("done")).select(*grams.columns)
        edits = edits + 1 if edits < 4 else edits + edits // 2
    if not settled:
        return exact
    best = reduce(DataFrame.unionByName, settled)
    return exact.unionByName(lk.join(best, "key").join(rk, "rkey").select("name", "match", "similarity"))
