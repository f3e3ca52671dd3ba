"""Near duplicates and repeated strings against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest

from tessella.llm import near_dedup, repeat_removal, suffix_arrays
from tessella.llm.components import connected_components
from tessella.llm.vectors import batch_word_hashes

from . import made

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = made.WORD.findall((text or "").translate(LOWER))
    k = min(len(w), 5)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def components(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def edited(rng, text, share):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def near_rows(rng):
    texts = made.odd_texts(rng)
    for n in (3, 5, 9, 30, 120):
        base = made.prose(rng, n, 3000)
        texts += [base, base.upper(), base + " end"] + [edited(rng, base, rng.choice([0.01, 0.03, 0.05, 0.08])) for _ in range(15)]
    chain = made.prose(rng, 100, 3000)
    for _ in range(12):  # each like the one before, the ends unlike
        chain = edited(rng, chain, 0.025)
        texts.append(chain)
    common = made.prose(rng, 60, 3000)
    texts += [made.prose(rng, 40, 3000) + " " + common + " " + made.prose(rng, 40, 3000) for _ in range(20)]
    return [(3 * i + 7, t) for i, t in enumerate(texts)]


def test_near_duplicates(spark):
    rows = near_rows(random.Random(5))
    got = near_dedup.near_duplicates(made.documents(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == components(rows)


def test_mixed_buckets_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 300)
    rng = random.Random(6)
    base = made.prose(rng, 100, 3000)
    rows = [(i, edited(rng, base, rng.choice([0.02, 0.04, 0.05, 0.06]))) for i in range(60)]
    got = near_dedup.near_duplicates(made.documents(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == components(rows)


def test_near_duplicates_of_repeated_and_null_ids(spark):
    rng = random.Random(7)
    a, b = made.prose(rng, 60, 3000), made.prose(rng, 60, 3000)
    docs = made.documents(spark, [(4, a), (4, a), (9, a), (None, a), (None, b), (6, b), (8, None), (8, "")])
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(4, a), (0, a), (0, b), (6, b), (8, "")])
    assert near_dedup.drop_near_duplicates(docs.where("false")).count() == 0


def test_word_hashes_do_not_depend_on_blocks():
    rng = random.Random(8)
    text = (made.prose(rng, 300_000, 10**6) + " " + "y" * 2_500_000 + " tail").encode()
    hashes, at = batch_word_hashes([text, b"", b"  w1 W2"])
    alone = [batch_word_hashes([w])[0][0] for w in (b"tail", b"w1", b"w2")]
    assert list(at[1:]) == [at[1], at[1], at[1] + 2] and at[1] == 300_002
    assert [hashes[at[1] - 1], hashes[-2], hashes[-1]] == alone


def test_components_of_a_long_chain(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 200), (300, 200), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}


# ------------------------------------------------------------ repeated strings


def without_repeats(rows):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        t = (text or "").encode()
        gone = bytearray(len(t))
        for a in range(len(t) - 99):
            w = t[a : a + 100]
            if w in seen:
                gone[a : a + 100] = b"\1" * 100
            seen.add(w)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((doc, len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def repeat_rows(rng):
    line, passage = made.prose(rng, 30), made.prose(rng, 70)
    texts = made.odd_texts(rng) + ["ab " * 300, ("ab " * 300)[1:], "x" * 99, "x" * 100, "x" * 150, line, passage]
    for _ in range(120):
        c = rng.random()
        t = made.prose(rng, rng.randrange(1, 90))
        if c < 0.3:
            t = made.prose(rng, rng.randrange(20)) + line + made.prose(rng, rng.randrange(20))
        elif c < 0.5:
            t = passage[rng.randrange(60) :] + "é" + passage[: rng.randrange(90, 250)]
        elif c < 0.65:
            t = rng.choice(texts) or ""
            t = t[: len(t) // 2] + "Q" + t[len(t) // 2 :]
        elif c < 0.75:
            t = rng.choice(texts)
        texts.append(t)
    ids = rng.sample(range(1000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("shard", [repeat_removal.SHARD_BYTES, 400])
def test_repeats_are_removed(spark, shard):
    rows = repeat_rows(random.Random(9))
    got = repeat_removal.remove_repeats(made.documents(spark, rows), shard_bytes=shard).collect()
    assert sorted(tuple(r) for r in got) == without_repeats(rows)


def test_repeats_in_repeated_rows_and_null_ids(spark):
    t = made.prose(random.Random(10), 60)
    got = repeat_removal.remove_repeats(made.documents(spark, [(5, t), (5, t), (None, t), (2, "short"), (2, "short")])).collect()
    n = len(t.encode())
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 0), (2, 0), (2, 0), (5, n), (5, n)]
    assert repeat_removal.remove_repeats(made.documents(spark, [(5, t)]).where("false")).count() == 0


def test_many_rows_without_id(spark):
    """Copies are counted, not searched: thousands of equal rows, beside others."""
    rng = random.Random(13)
    t, u = made.prose(rng, 400), made.prose(rng, 60)
    rows = [(None, t)] * 5000 + [(None, u)] * 40 + [(None, f"{u} {t[:500]}"), (None, "short"), (None, "short"), (3, "x" + u)]
    got = repeat_removal.remove_repeats(made.documents(spark, rows)).collect()
    assert len(got) == len(rows)
    whole = {len(x.encode()): sum(r.n_bytes == len(x.encode()) and r.n_removed == 0 for r in got) for x in (t, u)}
    assert all(kept <= 1 for kept in whole.values())
    assert sum(r.n_removed == r.n_bytes for r in got) >= 5038
    assert sum(r.n_bytes - r.n_removed for r in got) < len(t) + 2 * len(u) + 400


def test_texts_of_equal_short_hash_stay_apart(spark):
    """Rows without id whose texts share the 32-bit hash of Spark."""
    from pyspark.sql import functions as F

    made_up = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 512).alias("a"))
    texts = made_up.select(F.concat("a", "a").alias("t"), F.hash(F.concat("a", "a").cast("binary")).alias("h"))
    pair = texts.groupBy("h").agg(F.collect_set("t").alias("ts")).where("size(ts) > 1").first()["ts"][:2]
    got = repeat_removal.remove_repeats(made.documents(spark, [(None, x) for x in pair])).collect()
    assert sorted(r.n_removed for r in got) == sorted(r[2] for r in without_repeats([(0, pair[0]), (1, pair[1])]))


def test_suffix_arrays():
    rng = random.Random(11)
    for _ in range(150):
        text = "".join(rng.choice(rng.choice(["ab", "a", "abcd"])) for _ in range(rng.randrange(1, 90))) * rng.randrange(1, 4)
        s = np.array([ord(c) - 96 for c in text] + [0], np.int64)
        whole = s.tolist()
        for depth in (4, 10**6):
            sa = suffix_arrays.suffix_array(s, depth)
            assert sorted(sa) == list(range(len(s)))
            assert [whole[i : i + depth] for i in sa] == sorted(whole[i : i + depth] for i in sa)
        shared = suffix_arrays.common_prefixes(s, sa, 5)
        for a, b in zip(sa, sa[1:]):
            same = next((m for m in range(5) if a + m >= len(s) or b + m >= len(s) or s[a + m] != s[b + m]), 5)
            assert shared[b] == same
