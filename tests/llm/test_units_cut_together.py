"""Texts of a call are cut into units together, each distinct unit is encoded once."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from tessella.llm import grammar_ids, token_units


def test_distinct_words_of_a_call_are_looked_up_once(monkeypatch):
    looked, plain = Counter(), grammar_ids.unit_encoder

    def counted(*args):
        encode = plain(*args)

        def one(unit):
            looked[unit] += 1
            return encode(unit)

        return one

    monkeypatch.setattr(grammar_ids, "unit_encoder", counted)
    encode = grammar_ids.texts_encoder(grammar_ids.VOCABULARY, grammar_ids.PATTERN)
    model = Tokenizer.from_file(grammar_ids.VOCABULARY)
    texts = ["the cat, the dog.\nThe cat and the.cat", None, "", " the cat,", "the <|endoftext|> cat  \n\nx"] * 30
    want = [model.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    ids, sizes = encode(pa.array(texts), 2)
    assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))
    assert max(looked.values()) == 1
    assert " cat" in looked and " cat," not in looked and "\nThe" not in looked


def test_units_of_bytes_are_those_of_texts():
    spaces = "".join(regex.findall(r"\s", "".join(map(chr, range(0x3001)))))
    rng = random.Random(5)
    texts = ["".join(rng.choice(spaces + " \n\x1c\x00-aé漢。") for _ in range(rng.randrange(40))) for _ in range(300)]
    rows = [t.encode() for t in texts]
    starts = np.cumsum([0, *map(len, rows)])[:-1]
    begins = token_units.unit_begins(np.frombuffer(b"".join(rows), np.uint8), starts)
    want = np.cumsum([0, *(len(u.encode()) for t in texts for u in token_units.units(t))])[:-1]
    assert np.flatnonzero(begins).tolist() == want.tolist()
    assert token_units.unit_begins(np.zeros(0, np.uint8), np.zeros(3, np.int64)).tolist() == []


def test_ids_of_odd_texts_cut_together():
    model = Tokenizer.from_file(grammar_ids.VOCABULARY)
    alphabet = [" ", "\n", "\t", ".", ",", "a", "B", "é", "漢", "1", "'s", "'", "\u2003", "\u3000", "\x1c", "\xff", "ing", "e\u0301", "<|endoftext|>"]
    rng = random.Random(6)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(2000)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)}).slice(3)
    encode = grammar_ids.texts_encoder(grammar_ids.VOCABULARY, grammar_ids.PATTERN)
    got = [encode(s.column("text"), 2) for s in grammar_ids.slices(batch, "text", 3000)]
    want = [model.encode(t, add_special_tokens=False).ids + [2] for t in texts[3:]]
    assert len(got) > 10
    assert np.concatenate([ids for ids, _ in got]).tolist() == sum(want, [])
    assert np.concatenate([sizes for _, sizes in got]).tolist() == list(map(len, want))
