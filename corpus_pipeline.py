"""A training corpus from ``documents``, stage by stage.

Every stage reads what the one before it wrote.  The first four return rows with
the columns of ``documents``: documents of low quality go, one document stays of
each group of near duplicates, documents that hold benchmark items go, secrets
are masked in what remains.  The last one encodes the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import byte_bpe, decontaminate, near_dedup, quality_rules, secret_scans
from tessella.llm.registry import table
from tessella.session import materialize


def pass_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules on their own and whose host does."""
    return quality_rules.drop_rejected(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates."""
    return near_dedup.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mask."""
    return secret_scans.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded bytes."""
    return byte_bpe.encode_documents(docs)


STAGES = [
    ("quality_rules", pass_quality_rules),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scans", mask_secrets),
    ("byte_bpe", encode),
]

#: Alignment, minhash and byte-pair merges have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
