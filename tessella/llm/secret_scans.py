"""Secret scans through an incremental ledger of content-addressed blobs, in
DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content.  A
ledger holds, per (blob, rule, rule version), the spans found; only pairs it
lacks are scanned, each distinct blob once however many paths and versions hold
it, and findings are joined back to all paths.

Scale.  One shuffle brings each distinct blob to one row (map-side combine, so a
blob that is a third of all rows is one row per map task); scanning itself is a
projection.  Joining back moves only (path, blob) pairs and findings; the skewed
side of that join is split at run time.  Masking moves the texts in which a rule's
pattern occurs, besides.

Defined results.  A null text is an empty blob.  Repeated rows each get their
row.  An empty table gives no rows.  Ties (equal starts) are ordered by rule.
Positions are code points, the end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.registry import let, query, table, unused
from tessella.session import materialize


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; a match counts if
    ``group`` has ``least`` characters.  Change ``version`` with the rule."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    base: bool = True


RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("host_token", r"(?:gh[pousr]_|xox[abprs]-|glpat-)[A-Za-z0-9_-]{20,}", base=False),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", base=False),
)

#: Matches whose places are added up together.
RUN = 64
SPAN = "array<struct<start:bigint,end:bigint>>"
FINDINGS = f"blob string, kind string, version int, spans {SPAN}"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def rule_spans(text: Column, rule: Rule) -> Column:
    """Spans of one rule: lengths of what is between matches and of the matches
    give their places.  Texts without a match stop at one search."""
    pattern = F.lit(rule.pattern)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["found"])
        here = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        spans = F.when(F.char_length(x["kept"]) >= rule.least, F.concat(acc["spans"], here)).otherwise(acc["spans"])
        return F.struct(end.cast("long").alias("at"), spans.alias("spans"))

    def place(parts: Column) -> Column:
        """Runs of matches are placed from their own start, then moved to where
        the runs before them end: a text with many matches stays cheap."""
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("spans"))
        starts = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / RUN).cast("int"))
        runs = F.transform(starts, lambda i: F.aggregate(F.slice(parts, i * RUN + 1, RUN), zero, step))

        def moved(runs: Column) -> Column:
            def one(run: Column, i: Column) -> Column:
                before = F.aggregate(F.slice(runs, 1, i), F.lit(0).cast("long"), lambda a, r: a + r["at"])
                return let(
                    before,
                    lambda b: F.transform(
                        run["spans"], lambda s: F.struct((s["start"] + b).alias("start"), (s["end"] + b).alias("end"))
                    ),
                )

            return F.flatten(F.transform(runs, one))

        return let(runs, moved)

    found = F.regexp_extract_all(text, pattern, F.lit(0))
    kept = found if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))

    def zipped(f: Column) -> Column:
        gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(f))
        return F.arrays_zip(gaps.alias("gap"), f.alias("found"), (f if rule.group == 0 else kept).alias("kept"))

    none = F.array().cast(SPAN)
    return F.when(text.rlike(rule.pattern), let(let(found, zipped), place)).otherwise(none)


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, kind, version, spans) of (blob, text) rows with ``todo``, the
    kinds still to be scanned; blobs without findings are entered too."""
    results = [
        F.when(
            F.array_contains("todo", r.kind),
            F.struct(
                F.lit(r.kind).alias("kind"),
                F.lit(r.version).alias("version"),
                rule_spans(F.col("text"), r).alias("spans"),
            ),
        )
        for r in rules
    ]
    return (
        blobs.select("blob", F.explode(F.array(*results)).alias("r"))
        .where(F.col("r").isNotNull())
        .select("blob", "r.*")
    )


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, text: str = "text",
                  rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger entries: blobs of ``docs`` under rule versions not yet seen.

    ``ledger`` holds entries of earlier runs (schema ``FINDINGS``).
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(blob_id(F.col(text)).alias("blob"), content.alias("text"))
    every = F.array(*[F.lit(r.kind) for r in rules])
    if ledger is not None:
        now = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
        seen = (
            ledger.where(F.col("version") == F.try_element_at(now, F.col("kind")))
            .groupBy("blob")
            .agg(F.collect_set("kind").alias("seen"))
        )
        rows = rows.join(seen, "blob", "left").withColumn(
            "todo", F.array_except(every, F.coalesce(F.col("seen"), F.array().cast("array<string>")))
        )
        rows = rows.where(F.size("todo") > 0).drop("seen")
        distinct = rows.groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
    else:
        distinct = rows.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", every)
    return scan(distinct, rules)


def findings_by_blob(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans): all spans under the current rules, one row per blob that has any."""
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    now = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    hits = ledger.where((F.size("spans") > 0) & (F.col("version") == F.try_element_at(now, F.col("kind"))))
    named = F.transform(
        "spans",
        lambda s: F.struct(
            s["start"].alias("start"), F.try_element_at(rank, F.col("kind")).alias("rank"),
            s["end"].alias("end"), F.col("kind").alias("kind"),
        ),
    )
    return (
        hits.select("blob", "kind", named.alias("spans"))
        .dropDuplicates(["blob", "kind"])
        .groupBy("blob")
        .agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    )


def grown_ledger(docs: DataFrame, ledger: DataFrame | None = None, text: str = "text",
                 rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``ledger`` with the entries that ``docs`` adds to it, written."""
    new = materialize(update_ledger(docs, ledger, text, rules), "secret-ledger")
    return new if ledger is None else ledger.select(new.columns).unionByName(new)


def find_secrets(docs: DataFrame, ledger: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text",
                 rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings per row of ``docs``, ledger with what this run added)."""
    whole = grown_ledger(docs, ledger, text, rules)
    found = findings_by_blob(whole, rules)
    paths = docs.select(F.col(doc_id).alias("doc_id"), blob_id(F.col(text)).alias("blob"))
    return paths.join(found, "blob", "left"), whole


def _merged(spans: Column) -> Column:
    """Overlapping spans, sorted by start, as one; a span starts a new one where it
    begins at or after the ends of all before it."""
    ends = F.transform(spans, lambda s: s["end"])
    new = F.filter(
        F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"))),
        lambda s: (s["i"] == 0) | (s["start"] >= F.array_max(F.slice(ends, 1, s["i"]))),
    )

    def closed(heads: Column) -> Column:
        upto = lambda k: F.when(k + 1 < F.size(heads), F.get(heads, k + 1)["i"]).otherwise(F.size(spans))
        return F.transform(heads, lambda h, k: F.struct(h["start"].alias("start"), F.array_max(F.slice(ends, 1, upto(k))).alias("end")))

    return let(new, closed)


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with the merged spans replaced: its pieces, joined once."""

    def piece(spans: Column) -> Column:
        def before(s: Column, i: Column) -> Column:
            start = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
            return F.substring(text, (start + 1).cast("int"), (s["start"] - start).cast("int"))

        rest = F.substring(text, (F.element_at(spans, -1)["end"] + 1).cast("int"), F.lit(2147483647))
        return F.array_join(F.concat(F.transform(spans, before), F.array(rest)), mask)

    return let(_merged(spans), piece)


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", mask: str = "[secret]",
           rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """``docs`` with every found span replaced by ``mask``; overlapping spans
    become one mask.  ``n_chars``, where given, is counted again.

    Spans come from the ledger, grown by the blobs of ``docs``.  Rows meet their
    findings by blob; texts in which no rule's pattern occurs have none and stay
    where they are, so only the few others are shuffled for the masks.
    """
    whole = grown_ledger(docs, ledger, text, rules)
    blob, spans, new = (unused(docs, n) for n in ("blob", "found_spans", "masked_text"))
    found = findings_by_blob(whole, rules).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    may_hold = F.coalesce(reduce(Column.__or__, [F.col(text).rlike(r.pattern) for r in rules]), F.lit(False))
    masked = (
        docs.where(may_hold)
        .withColumn(blob, blob_id(F.col(text)))
        .join(found, blob, "left")
        .withColumn(new, F.when(F.col(spans).isNotNull(), _masked(F.col(text), F.col(spans), mask)).otherwise(F.col(text)))
    )
    changed = {text: F.col(new)}
    if n_chars and n_chars in docs.columns:
        counted = F.char_length(new).cast(docs.schema[n_chars].dataType)
        changed[n_chars] = F.when(F.col(spans).isNotNull(), counted).otherwise(F.col(n_chars))
    held = masked.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])
    return docs.where(~may_hold).unionByName(held)


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts per base kind, the hash of the base spans, and all spans as text."""
    spans = F.coalesce(F.col("spans"), F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>"))
    base = [r.kind for r in rules if r.base]

    def joined(of: Column) -> Column:
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, base),
        F.sha2(joined(F.filter(spans, lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same in DuckDB: lengths of gaps and matches give the places."""
    found = []
    for rank, r in enumerate(rules):
        pattern = r.pattern.replace("'", "''")
        found.append(
            f"""SELECT doc_id, '{r.kind}' AS kind, {rank} AS rank, {r.base} AS base, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
  'start': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
  'size': length(m[i]), 'kept': length(v[i])}})) AS s, {r.least} AS least
FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g,
  regexp_extract_all(text, '{pattern}', {r.group}) AS v FROM d WHERE regexp_matches(text, '{pattern}'))"""
        )
    base = [r.kind for r in rules if r.base]
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(found)}),
k AS (SELECT doc_id, kind, rank, base, CAST(s.start AS BIGINT) AS a, CAST(s.start + s.size AS BIGINT) AS z FROM f WHERE s.kept >= least),
t AS (
  SELECT doc_id, {counts},
    string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) FILTER (WHERE base) AS base_spans,
    string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) AS spans
  FROM k GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in base)},
  sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN t USING (doc_id)
"""


@query("op7_secret_scans", oracle())
def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, scanned once per distinct blob."""
    return digest(find_secrets(table(spark, sf_dir, "documents"))[0])
