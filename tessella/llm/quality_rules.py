"""Quality rules judged per document and per host, in DataFrame functions only.

Each text is measured by itself; failures of the base rules are summed by host;
a host's failure rate is shrunk towards the corpus by a beta prior fitted to all
hosts (empirical Bayes); a host whose shrunk rate is above ``max_host_rate``
loses all its documents.

Scale.  Measuring needs no shuffle.  The per-host sums combine on the map side,
so a host with a third of all rows is one row per map task.  Verdicts are joined
back to a narrow table of measures (or, when whole rows are filtered, to the
rows); the verdict table is written first, so its true size decides between a
broadcast and a shuffled join whose skewed side is split at run time.

Defined results.  A null or empty text has no words and fails.  A null host
belongs to no host: its documents are judged alone.  Repeated rows are measured
and counted like any other row.  An empty table gives no rows.  Columns of the
input other than the text and the host never take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.registry import let, query, table, unused
from tessella.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MAX_HOST_RATE = 0.5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated_words(words: Column, window: int = 3) -> Column:
    """Words covered by windows that occur at least twice in the text.

    Windows are compared by 64-bit hashes; equal ones become neighbours in one
    sort, so a long repetitive text costs n log n.
    """

    def starts(keyed: Column) -> Column:
        same = F.filter(
            keyed,
            lambda x, i: F.coalesce(F.get(keyed, i - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(keyed, i + 1)["h"] == x["h"], F.lit(False)),
        )
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def covered(pos: Column) -> Column:
        step = F.transform(
            pos, lambda p, j: F.least(F.lit(window), F.coalesce(F.get(pos, j + 1) - p, F.lit(window)))
        )
        return F.aggregate(step, F.lit(0), lambda acc, x: acc + x)

    def keyed(hashes: Column) -> Column:
        return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def count(hashes: Column) -> Column:
        found = let(keyed(hashes), lambda k: let(starts(k), covered))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), found).otherwise(F.lit(0))

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - window),
        lambda i: F.xxhash64(*[words[i + k] for k in range(window)]),
    )
    return F.when(F.size(words) > window, let(hashes, count)).otherwise(F.lit(0))


def measures(text: Column) -> Column:
    """Struct of the base measures (long) and ``base_failed`` of one text."""
    text = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeated_words(words).cast("long").alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    dup_lines = let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))
    words = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words)

    def whole(w: Column) -> Column:
        return F.struct(
            w["n_words"].alias("n_words"),
            w["word_chars"].alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            dup_lines.cast("long").alias("n_dup_lines"),
            w["n_repeat_words"].alias("n_repeat_words"),
            (
                (w["n_words"] < MIN_WORDS)
                | (100 * w["n_repeat_words"] > MAX_REPEATED_PERCENT * w["n_words"])
            ).alias("base_failed"),
        )

    return let(words, whole)


def host_rates(judged: DataFrame, host: str, failed: str) -> DataFrame:
    """(host, n_docs, n_failed, host_rate): failure rates shrunk by a beta prior.

    The prior's mean is the corpus rate and its strength comes from the moments
    of the beta-binomial: with N documents, F failures and S2 = sum of squared
    host sizes, the between-host share rho solves E[S] for
    S = sum(f^2/n) - F^2/N.  Where hosts differ no more than chance (rho <= 0)
    or only one host exists, the prior weighs as much as the whole corpus.
    """
    hosts = (
        judged.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    )
    stats = hosts.agg(
        F.struct(
            F.count("*").alias("k"),
            F.sum("n_docs").alias("n"),
            F.sum("n_failed").alias("f"),
            F.sum(F.col("n_docs").cast("double") * F.col("n_docs")).alias("n2"),
            F.sum(F.col("n_failed").cast("double") * F.col("n_failed") / F.col("n_docs")).alias("f2n"),
        )
    ).scalar()

    def shrink(s: Column) -> Column:
        n, k = s["n"].cast("double"), s["k"].cast("double")
        mean = s["f"] / n
        spread = mean * (1 - mean)
        excess = s["f2n"] - s["f"] * mean - spread * (k - 1)
        room = spread * (n - s["n2"] / n - (k - 1))
        rho = F.try_divide(excess, room)
        strength = F.when((rho > 0) & (rho < 1), F.least(1 / rho - 1, n)).when(rho >= 1, F.lit(0.0)).otherwise(n)
        return let(strength, lambda m: (F.col("n_failed") + mean * m) / (F.col("n_docs") + m))

    return hosts.withColumn("stats", stats).select(
        "host", "n_docs", "n_failed", shrink(F.col("stats")).alias("host_rate")
    )


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
          max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per input row: its id, host, measures, base_failed, host_rate, kept."""
    m = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), measures(F.col(text)).alias("m"))
    m = materialize(m.select("doc_id", "host", "m.*"), "quality-measures")
    rates = materialize(host_rates(m, "host", "base_failed"), "quality-hosts").select("host", "host_rate")
    bad = F.coalesce(F.col("host_rate") > max_host_rate, F.lit(False))
    return m.join(rates, "host", "left").withColumn("kept", ~(F.col("base_failed") | bad))


def drop_rejected(docs: DataFrame, text: str = "text", host: str = "source",
                  max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that pass their own rules and whose host is accepted.

    The rules are evaluated once per row and written beside it; the hosts' rates
    come from two columns of that table.  Only hosts above the limit, written first
    so that their size is known, are anti-joined; no text is shuffled.
    """
    name, failed = unused(docs, "rejected_host"), unused(docs, "base_failed")
    judged = materialize(docs.withColumn(failed, measures(F.col(text))["base_failed"]), "quality-judged")
    rejected = host_rates(judged.select(F.col(host).alias("host"), F.col(failed).alias("failed")), "host", "failed")
    rejected = rejected.where(F.col("host_rate") > max_host_rate)
    rejected = materialize(rejected.select(F.col("host").alias(name)), "quality-rejected")
    return judged.where(~F.col(failed)).drop(failed).join(rejected, F.col(host) == F.col(name), "left_anti")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
base AS (
  SELECT doc_id, source, len(words) AS n_words,
         length(array_to_string(words, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
tri AS (
  SELECT doc_id, i, (words[i], words[i + 1], words[i + 2]) AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS n FROM tri) WHERE n > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1),
m AS (
  SELECT b.doc_id, b.source, n_words, word_chars, n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM base b LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
hosts AS (
  SELECT source, count(*) AS n, sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS f
  FROM f WHERE source IS NOT NULL GROUP BY 1),
s AS (
  SELECT count(*) AS k, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(f) AS DOUBLE) AS f,
         sum(CAST(n AS DOUBLE) * n) AS n2, sum(CAST(f AS DOUBLE) * f / n) AS f2n FROM hosts),
prior AS (
  SELECT f / n AS mean, n,
         (f2n - f * f / n - (f / n) * (1 - f / n) * (k - 1))
           / nullif((f / n) * (1 - f / n) * (n - n2 / n - (k - 1)), 0) AS rho FROM s),
strength AS (
  SELECT mean, CASE WHEN rho > 0 AND rho < 1 THEN least(1 / rho - 1, n) WHEN rho >= 1 THEN 0 ELSE n END AS m
  FROM prior),
verdict AS (SELECT source, (f + mean * m) / (n + m) > 0.5 AS bad FROM hosts, strength)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR coalesce(bad, FALSE)) AS kept
FROM f LEFT JOIN verdict USING (source)
"""


@query("op1_quality_rules", SQL)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures, base failures and the verdict on every document."""
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *MEASURES, "base_failed", "kept")
