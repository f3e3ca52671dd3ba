"""Rounds of pair replacement do not sort the places they replace."""

import numpy as np

from tessella.llm import grammar_ids


def test_rules_are_numbered_without_sorting_their_places(monkeypatch):
    rng = np.random.default_rng(1)
    ids = rng.zipf(1.5, 20_000).astype(np.uint32) % 500
    sorted_sizes, plain = [], np.unique

    def unique(a, *args, **named):
        sorted_sizes.append(len(a))
        return plain(a, *args, **named)

    monkeypatch.setattr(np, "unique", unique)
    s, pairs, spans = grammar_ids.re_pair(ids, 500, per_round=50)
    assert max(sorted_sizes) <= 50 < len(pairs)
    assert grammar_ids.expand(s, pairs, 500).tolist() == ids.tolist()
    assert grammar_ids.expand_whole(s, pairs, spans, 500).tolist() == ids.tolist()
