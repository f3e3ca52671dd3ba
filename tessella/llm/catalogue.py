"""Imports every operator so that the registry is complete."""

from tessella.llm import (
    byte_bpe,
    chat_format,
    decontaminate,
    grammar_ids,
    html_text,
    kd_shards,
    merkle,
    near_dedup,
    prefix_trie,
    quality_rules,
    repeat_removal,
    secret_scans,
    toxicity,
)
from tessella.llm.registry import ORACLES, QUERIES

OPERATORS = (
    quality_rules,
    byte_bpe,
    kd_shards,
    chat_format,
    html_text,
    decontaminate,
    secret_scans,
    repeat_removal,
    grammar_ids,
    near_dedup,
    prefix_trie,
    merkle,
    toxicity,
)

__all__ = ["OPERATORS", "ORACLES", "QUERIES"]
