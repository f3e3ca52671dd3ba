"""Decontamination against edit distances, and the pipeline against brute force."""

import hashlib
import importlib
import os
import random
import re
import sys

import pytest

from tessella.llm import byte_bpe, decontaminate
from tessella.llm.catalogue import ORACLES, QUERIES

from . import made
from .test_dedup_operators import components, edited
from .test_native_operators import measures, spans


def distance(item, text):
    """Fewest edits between the item and any substring of the text."""
    return nearest(decontaminate.normalized(item)[0], decontaminate.normalized(text)[0])


def plain_leak(item, text):
    """Edits of the longest region of the item within a tenth of its length, or None."""
    a, b = decontaminate.normalized(item or "")[0], decontaminate.normalized(text or "")[0]
    if len(a) < decontaminate.SHORT:
        return 0 if len(a) and a.tobytes() == b.tobytes() else None
    found = [(lo - hi, nearest(a[lo:hi], b), k) for lo, hi, k in decontaminate.regions(len(a))]
    found = [(size, e) for size, e, k in found if e <= k]
    return min(found)[1] if found and len(b) else None


def nearest(a, b):
    before = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(before[j] + (x != y), before[j + 1] + 1, now[j] + 1))
        before = now
    return min(before)


def scrambled(rng, text, edits):
    s = list(text)
    for _ in range(edits):
        p = rng.randrange(len(s))
        c = rng.random()
        if c < 0.4:
            s[p] = rng.choice("abcd ")
        elif c < 0.7 and len(s) > 1:
            del s[p]
        else:
            s.insert(p, rng.choice("abcd "))
    return "".join(s)


def noise(rng, n):
    return "".join(rng.choice("abcde fgh") for _ in range(n)).strip() or "a"


def test_leaks_are_those_within_the_edit_budget(spark):
    rng = random.Random(1)
    items = [(i, noise(rng, rng.choice([9, 12, 16, 20, 23, 24, 30, 40, 60, 90, 150]))) for i in range(22)]
    items += [(100, None), (101, ""), (102, "hi there"), (103, items[0][1])]
    texts = [None, "", "Hi \n THERE ", "hi there you", items[3][1].upper().replace(" ", "\t \n")]
    for _ in range(50):
        t = rng.choice(items[:22])[1]
        middle = scrambled(rng, t, rng.randrange(0, max(1, len(t) * 16 // 100)))
        texts.append(rng.choice([noise(rng, 40) + " " + middle + noise(rng, 60), middle, noise(rng, 120)]))
    rows = list(enumerate(texts)) + [(4, texts[4])]
    bench = spark.createDataFrame([(*i, "x") for i in items + items[:1]], "item_id long, text string, doc_id string")
    every = [(d, i, plain_leak(x, t)) for d, t in rows for i, x in items]
    want = sorted(w for w in every if w[2] is not None)
    docs = made.documents(spark, rows)
    for block in (decontaminate.BLOCK_CHARS, 500):
        got = decontaminate.leaks(docs, bench, block_chars=block).collect()
        assert sorted((r.doc_id, r.item_id, r.edits) for r in got) == want
    for r in got:
        a, b = decontaminate.normalized(dict(items)[r.item_id])[0], decontaminate.normalized(texts[r.doc_id][r.start : r.end])[0]
        assert r.edits in [nearest(a[lo:hi], b) for lo, hi, _ in decontaminate.regions(len(a)) or [(0, len(a), 0)]]
    for block in (decontaminate.BLOCK_CHARS, 500):
        clean = decontaminate.drop_contaminated(docs, bench, block_chars=block)
        assert clean.columns == docs.columns
        assert sorted(r.doc_id for r in clean.collect()) == sorted({d for d, _ in rows} - {d for d, _, _ in want})
    assert decontaminate.leaks(docs, bench.where("false")).count() == decontaminate.leaks(docs.where("false"), bench).count() == 0


def test_rows_of_one_id_or_none_go_by_their_own_text(spark):
    rng = random.Random(4)
    item = noise(rng, 90)
    rows = [(i, t) for i in (None, 7, None) for t in (noise(rng, 80), noise(rng, 30) + item + noise(rng, 30), None)]
    rows += [(8, "clean"), (None, rows[1][1]), (None, "clean"), (None, "")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = decontaminate.drop_contaminated(made.documents(spark, rows), bench).collect()
    want = [r for r in rows if plain_leak(item, r[1]) is None]
    assert sorted(((r.doc_id, r.text) for r in left), key=repr) == sorted(want, key=repr)
    assert 0 < len(want) < len(rows)


def test_the_whole_budget_short_items_and_long_parts():
    rng = random.Random(6)

    def found(item, text):
        return [(e, text[s:z]) for _, _, e, s, z in decontaminate.find_leaks(decontaminate.Index([(1, item)]), [text])]

    for n in (8, 12, 16, 17, 20, 22, 24, 30, 31, 32, 40, 64, 99):
        item = "".join(rng.choice("abcdefghij") for _ in range(n))
        places = sorted(rng.sample(range(1, n - 1), n // 10))
        text = "zz " + "".join("Z" if i in places else c for i, c in enumerate(item)) + " yy"
        assert [e for e, _ in found(item, text)] == [n // 10]
    assert found("answer is 42", "They say the answer  is 42, mostly.") == [(0, "answer  is 42")]
    assert found("is 42", "They say the answer is 42, mostly.") == []  # too short to be told from chance
    for n in (110, 200, 900, 5000):
        item = "".join(rng.choice("abcdefghij ") for _ in range(n)).strip()
        lo = rng.randrange(len(item) // 8)
        assert found(item, "word " + item[lo : lo + len(item) * 88 // 100] + " more words")
    long = "".join(rng.choice("abcdefghij") for _ in range(1 << 21))
    assert found(long[: 1 << 20], "x" + long[5000:5200] + "y")


def test_a_leak_across_pieces_of_a_long_text(monkeypatch):
    monkeypatch.setattr(decontaminate, "BATCH_CHARS", 1000)
    rng = random.Random(2)
    item = noise(rng, 200)
    text = noise(rng, 950) + " " + item + " " + noise(rng, 3000)
    found = list(decontaminate.find_leaks(decontaminate.Index([(1, item)]), [text, None, item]))
    assert [(r, i, e) for r, i, e, _, _ in found] == [(0, 1, 0), (2, 1, 0)]
    assert text[found[0][3] : found[0][4]] == item


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small corpus with every kind of case, as the pipeline reads it."""
    rng = random.Random(3)
    bench = [(i, made.prose(rng, 30, 5000)) for i in range(4)]
    base = made.prose(rng, 120, 5000)
    rows = [(i, made.prose(rng, 10 if i % 6 == 0 else rng.choice([80, 150]), 5000), f"s{i % 5}") for i in range(60)]
    rows += [(100 + i, edited(rng, base, 0.02), "s1") for i in range(6)] + [(110, base, "s2"), (110, base, "s2"), (111, base.upper(), "s3")]
    rows += [(200 + i, made.prose(rng, 60, 5000) + " " + t + " " + made.prose(rng, 30, 5000), "s4") for i, t in bench]
    rows += [(300, made.prose(rng, 70, 5000) + " password=abcdefgh12 end", "s1"), (301, None, "s1"), (302, "", None), (303, "same words " * 100, "s1")]
    rows += [(400 + i, "junk", "bad host") for i in range(30)] + [(450, made.prose(rng, 90, 5000), "bad host")]
    d = str(tmp_path_factory.mktemp("corpus"))
    made.documents(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, bench


def test_pipeline_against_brute_force(spark, corpus):
    pipeline = importlib.import_module("corpus_pipeline")
    d, rows, bench = corpus
    left = [(i, t) for i, t, host in rows if not measures(t)[-1] and host != "bad host"]
    kept = {i for i, (_, _, k) in components(left).items() if k}
    left = list({i: t for i, t in left if i in kept}.items())
    left = [(i, t) for i, t in left if all(plain_leak(x, t) is None for _, x in bench)]
    masked = []
    for i, t in left:
        for s in reversed(spans(t)):
            _, a, z = s.split(":")
            t = t[: int(a)] + "[secret]" + t[int(z) :]
        masked.append((i, t))
    enc = byte_bpe.encoding(byte_bpe.RANKS, byte_bpe.PATTERN)
    want = sorted((i, len(enc.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in masked)
    got = pipeline.run(spark, d)
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in got.collect()) == want
    assert any("[secret]" in t for _, t in masked) and len(want) < len(rows)


def test_stages_keep_the_columns_of_documents(spark, corpus):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    assert 4 <= len(pipeline.STAGES) <= 5
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), corpus[0]).columns == docs.columns


def test_registry():
    assert sorted(int(re.match(r"op(\d+)_", n).group(1)) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_nothing_else_imports_these_operators():
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(top, "tessella")):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, n)).read()
    assert "tessella.llm" in sys.modules
