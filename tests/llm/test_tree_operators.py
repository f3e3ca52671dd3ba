"""Merkle manifest and prefix trie beside plain Python."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.llm import merkle, placing, prefix_trie

from .made import documents


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def canonical(fields):
    return sha(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def climbed(nodes):
    """Levels of one tree, from the leaves to its root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        start = at - at % 8
        out += [(level[start:at], level[at + 1 : start + 8])]
        at //= 8
    return out


def plain_manifest(rows):
    """(doc_id, leaf) to the list of (path, subroot, root); rows are field tuples."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, canonical(r)))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: climbed([g[2] for g in sorted(groups[k])]) for k in keys}
    over = climbed([trees[k][-1][0] for k in keys]) if keys else []
    out = defaultdict(list)
    for place, k in enumerate(keys):
        for at, (known, i, h) in enumerate(sorted(groups[k])):
            path = siblings(trees[k], at) + siblings(over, place)
            out[i if known else None, h].append((path, trees[k][-1][0], over[-1][0]))
    return out


def table(spark, rows):
    schema = "doc_id long, source string, lang string, n_chars long, text string, tree string, idx long, hash string, path string"
    return spark.createDataFrame([(*r, "t", 0, "h", "p") for r in rows], schema).repartition(5)


@pytest.mark.parametrize("case", ["mixed", "many groups", "one leaf"])
def test_manifest_equals_plain(spark, case):
    rng = random.Random(case)
    if case == "mixed":
        rows = [(i, rng.choice(["s", None]), "en" if i % 3 else None, i, f"Text {rng.random()} é") for i in range(700)]
        rows += [(None, None, "en", None, None)] * 40 + [(7, "s", "en", 1, "Ab")] * 9 + [(7, "s", "en", 2, ""), (-3, "s", "de", 2, "x" * 100_000)]
    elif case == "many groups":
        rows = [(i, "s", f"l{i % 70}" if i % 11 else "", 1, f"T{i}") for i in range(400)]
    else:
        rows = [(5, "s", "en", None, "A")]
    got = merkle.build(table(spark, rows)).proofs()
    got = got.withColumn("end", merkle.folded(F.col("hash"), F.col("path"))).withColumn("digest", merkle.proof_digest(F.col("path"))).collect()
    want = plain_manifest(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r["end"] == r["root"]
        path = [(list(p["left"]), list(p["right"])) for p in r["path"]]
        want[r["id"], r["hash"]].remove((path, r["subroot"], r["root"]))
        assert r["digest"] == sha(*[h for left, right in path for h in left + right])


def test_tampering_shows(spark):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(30)]
    p = merkle.build(table(spark, rows), seen=merkle.leaf([F.lower("text") if c == "text" else F.col(c) for c in merkle.COLUMNS])).proofs()
    assert all(r["end"] != r["root"] for r in p.withColumn("end", merkle.folded(F.col("seen"), F.col("path"))).collect())


def test_manifest_of_nothing(spark):
    assert merkle.build(table(spark, [])).proofs().collect() == []


def test_only_some_levels_are_stored(spark):
    m = merkle.build(table(spark, [(i, "s", "en", i, "t") for i in range(1100)]))
    assert [level.blocks.agg(F.sum(F.size("nodes"))).first()[0] for level in m.levels] == [1100, 3]


def test_places(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "a", "b"]), rng.choice([None, 1, 2]), rng.randrange(9)) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(7)
    got = placing.place(df, ["g"], ["o", "v"], ("v",)).collect()
    by = defaultdict(list)
    for r in got:
        by[r["g"]].append(r)
    for g, mine in by.items():
        mine.sort(key=lambda r: r["idx"])
        assert [r["idx"] for r in mine] == list(range(len(mine)))
        assert {r["size"] for r in mine} == {len(mine)}
        order = [(r["o"] is not None, r["o"] or 0, r["v"]) for r in mine]
        assert order == sorted(order)
        before = 0
        for r in mine:
            assert r["v_before"] == before
            before += r["v"]


# ------------------------------------------------------------------- trie


def plain_trie(sequences):
    """Nodes over {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    out = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(sequences[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.add((min(m), len(p), parent, len(m), len(kids[p]), leaves[p], saved[p], sha(ends)))
    return out


def grown(spark, sequences, container):
    rows = [(c, k, r, t, 1, "x") for c, turns in sequences.items() for k, (r, t) in enumerate(turns)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth long, head string").repartition(4)
    ids = spark.createDataFrame([(c,) for c in sequences], "conv_id long")
    nodes = prefix_trie.trie(prefix_trie.hashed(table), ids, ["turn"], container)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = [tuple(r[n] for n in names) for r in nodes.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("container", [1, 6, 10_000])
def test_trie_equals_plain(spark, container):
    rng = random.Random(9)
    sequences = {c: [(rng.choice("ab"), rng.choice(["", "x", "é"])) for _ in range(rng.randrange(6))] for c in range(-40, 160)}
    sequences[900] = [("a", "long")] * 300
    sequences[901] = [("a", "long")] * 300
    sequences |= {c: [("a", "x"), ("b", "hot")] for c in range(1000, 1400)}
    sequences |= {c: [("a", "x"), ("b", "hot"), ("a", str(c))] for c in range(5000, 5040)}
    assert grown(spark, sequences, container) == plain_trie(sequences)


def test_more_burst_heads_than_may_be_broadcast(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FEW", 0)
    rng = random.Random(10)
    sequences = {c: [(rng.choice("ab"), rng.choice("xyz")) for _ in range(rng.randrange(7))] for c in range(200)}
    assert grown(spark, sequences, 4) == plain_trie(sequences)


def test_odd_turns(spark):
    rows = [(1, None, "a", "first", 0), (1, 0, None, None, 0), (1, 5, "a", "t", 0), (2, 1, "a", "first", 0), (2, 1, "a", "first", 0), (None, 1, "a", "none", 0),
            (3, 0, "a", "x" * 200_000, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, idx long")
    turns = prefix_trie.hashed(df)
    nodes = prefix_trie.trie(turns, turns.select("conv_id").distinct(), ["turn"])
    got = {(r["conv_id"], r["depth"], r["n_convs"], r["n_children"], r["saved_tokens"]) for r in nodes.collect()}
    want = plain_trie({1: [("a", "first"), ("", ""), ("a", "t")], 2: [("a", "first")] * 2, 3: [("a", "x" * 200_000)]})
    assert got == {(n[0], n[1], n[3], n[4], n[6]) for n in want}


def test_trie_of_nothing(spark):
    empty = documents(spark, [(1, "t")]).where("doc_id < 0").selectExpr("doc_id conv_id", "n_chars turn", "lang role", "text")
    turns = prefix_trie.hashed(empty)
    assert prefix_trie.trie(turns, turns.select("conv_id"), ["turn"]).collect() == []


def test_splicing(spark):
    rng = random.Random(12)
    original = {c: [("u", f"{c}/{k}") for k in range(rng.randrange(1, 12))] for c in [-7, -5, -1, 0, 1, 3, 4, 6, 7, 9, 10, 14, 23, 25, 26]}
    rows = [(c, k, *t) for c, turns in original.items() for k, t in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    turns = prefix_trie.numbered(prefix_trie.hashed(df))
    keyed = df.select("conv_id", "role", "text", F.xxhash64("role", "text").alias("a")).drop_duplicates(["a"])
    text = {r["a"]: r["text"] for r in keyed.collect()}
    got = defaultdict(list)
    for r in prefix_trie.spliced(turns, lambda c: F.crc32(c.cast("string")) % 9).collect():
        got[r["conv_id"]].append((r["row_"], r["at"], text[r["a"]]))
    import math
    import zlib

    for c, turns_of in original.items():
        h = zlib.crc32(str(c).encode()) % 9
        donor = c - int(math.fmod(c, 5))
        want = [t for _, t in original.get(donor, [])[:h]] + [t for _, t in turns_of[h:]]
        assert [t for *_, t in sorted(got.get(c, []))] == want
