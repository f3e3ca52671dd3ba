"""Encoded ids against the tokenizer libraries, whole texts at once."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import AddedToken, Tokenizer

from tessella.llm import byte_bpe, grammar_ids, token_units
from tessella.session import scratch_path

from . import made


def texts(rng):
    alphabet = ["a", " ", "\n", "\t", "!", "1", "é", "\x1c", "'s", "漢", "　", "  ", "Z", " the"]
    mixed = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 1500))) for _ in range(25)]
    return made.odd_texts(rng) + mixed + ["  " * 900, "   ", "\n", "<|endoftext|>", "\x00 a\x00b"]


@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 1 << 10), (200, 20)])
def test_ids_of_whole_texts_and_of_chunks(spark, chunk, overlap):
    enc = byte_bpe.encoding(byte_bpe.RANKS, byte_bpe.PATTERN)
    rows = list(enumerate(texts(random.Random(1))))
    rows += [rows[10], rows[10], (None, rows[10][1]), (3, "another text of the same id " * 20)]

    def want(t):
        ids = enc.encode_ordinary(t or "")
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    got = byte_bpe.encode_documents(made.documents(spark, rows), chunk=chunk, overlap=overlap).collect()
    assert Counter(tuple(r) for r in got) == Counter((i, *want(t)) for i, t in rows)


def test_units_join_to_the_text():
    for t in texts(random.Random(2)):
        assert "".join(token_units.units(t or "")) == (t or "")
        assert "".join(token_units.Units(lambda u: u, size=5)(t or "")) == (t or "")


def test_chunk_seams():
    pattern = __import__("regex").compile(byte_bpe.PATTERN)
    lo, hi, pieces = byte_bpe.owned("one two three four", 0, 0, 8, 18, pattern)
    assert (lo, hi, pieces) == (0, 13, ["one", " two", " three"])
    lo, hi, pieces = byte_bpe.owned("wo three four", 5, 8, 18, 18, pattern)
    assert (lo, hi, pieces) == (13, 18, [" four"])
    assert byte_bpe.owned("xxxxxxxx", 10, 12, 16, 40, pattern)[1] == -1


def test_shards_of_ids(spark):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    rows = list(enumerate(texts(random.Random(3)))) + [(None, "null id first"), (4, None), (4, "b"), (4, "a")]
    path = scratch_path(spark, "test-ids")
    grammar_ids.write_shards(made.documents(spark, rows), path, shard_ids=5000)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in grammar_ids.read_documents(spark, path).collect())
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array(model.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert spark.read.parquet(path).count() > 1


def test_added_tokens_are_found_as_by_the_plain_library_call(spark, tmp_path):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    rows = list(enumerate([f"ab {end} cd", end, f"{end}{end}\n\n x", f"a\n\n{end}  b <|endoftext|", f"é {end}\t\n", "after", None]))
    made.documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = grammar_ids.op9_grammar_ids(spark, str(tmp_path)).collect()
    at, want = 0, []
    for i, t in rows:
        ids = np.array(model.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want


@pytest.mark.parametrize("single_word,lstrip,rstrip", [(False, True, False), (False, False, True), (True, False, False)])
def test_kinds_of_added_tokens(tmp_path, single_word, lstrip, rstrip):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.add_tokens([AddedToken("zed", single_word=single_word, lstrip=lstrip, rstrip=rstrip, normalized=False)])
    model.save(str(tmp_path / "v.json"))
    encode = grammar_ids.text_encoder(str(tmp_path / "v.json"), public_tokenizers.PATTERN)
    for t in ["a zed b", "azedb zed", "zed\n\n zed  <|endoftext|> zedzed", "ab"]:
        assert np.frombuffer(encode(t), "<u4").tolist() == model.encode(t, add_special_tokens=False).ids


def test_empty_tables(spark):
    none = made.documents(spark, [(1, "x")]).where("false")
    path = scratch_path(spark, "test-none")
    grammar_ids.write_shards(none, path)
    assert grammar_ids.read_documents(spark, path).count() == 0
    assert byte_bpe.encode_documents(none).count() == 0


@pytest.mark.parametrize("n,symbols", [(0, 1), (1, 1), (5000, 1), (4001, 2), (20000, 30), (300, 50000)])
def test_grammar_round_trip_and_seeks(n, symbols):
    ids = np.random.default_rng(n).integers(0, symbols, n).astype(np.uint32)
    s, pairs, spans = grammar_ids.re_pair(ids, 50257)
    assert (grammar_ids.expand(s, pairs, 50257) == ids).all()
    assert len(s) < n / 3 or symbols > 2 or n < 2
    shard = {"low": s.astype("<u2").tobytes(), "high": (s >> 16).astype("<u2").tobytes(), "pairs": pairs.tobytes(), "spans": spans.tobytes()}
    rng = random.Random(n)
    for _ in range(20):
        a = rng.randrange(n + 1)
        b = rng.randrange(a, n + 1)
        if b > a:
            assert (grammar_ids.read_span(shard, a, b, 50257) == ids[a:b]).all()


@pytest.mark.parametrize("n,symbols,times", [(1000, 1000, 64), (40, 40, 5000), (3000, 60, 40), (1, 1, 100000)])
def test_no_frequent_pair_is_left(n, symbols, times):
    ids = np.tile(np.random.default_rng(n).integers(0, symbols, n), times).astype(np.uint32)
    s, pairs, spans = grammar_ids.re_pair(ids, 50257, per_round=50)
    assert (grammar_ids.expand(s, pairs, 50257) == ids).all()
    assert (grammar_ids.expand_whole(s, pairs, spans, 50257) == ids).all()
    assert max(Counter(zip(s[:-1].tolist(), s[1:].tolist())).values(), default=0) < grammar_ids.MIN_COUNT
