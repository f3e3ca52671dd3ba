import random
import string

from tessella.operators import entities as E


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def key(s):
    out, word = [], ""
    for ch in s.lower() + " ":
        if ch.isalnum():
            word += ch
        elif word:
            out.append(word)
            word = ""
    return " ".join(sorted(out))


def test_fuzzy_match_equals_brute_force(spark):
    rng = random.Random(7)

    def word():
        return "".join(rng.choice(string.ascii_lowercase[:6]) for _ in range(rng.randint(1, 7)))

    right = sorted({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(60)})
    left = set()
    for r in right:
        s = list(r)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(s) + 1)
            op = rng.random()
            if op < 0.4:
                s.insert(i, rng.choice("abcdef "))
            elif s and op < 0.7:
                del s[min(i, len(s) - 1)]
            elif s:
                s[min(i, len(s) - 1)] = rng.choice("abcdef")
        left.add("".join(s) or "x")
    for thr in (0.8, 0.6):
        keys = {}
        for r in right:
            keys[key(r)] = min(keys.get(key(r), r), r)
        want = {}
        for n in left:
            k = key(n)
            if not k:
                continue
            best = sorted((-(1 - lev(k, rk) / max(len(k), len(rk))), rk) for rk in keys)[0]
            if -best[0] >= thr - 1e-12:
                want[n] = (keys[best[1]], round(-best[0], 9))
        ldf = spark.createDataFrame([(x,) for x in left], "n string")
        rdf = spark.createDataFrame([(x,) for x in right], "n string")
        got = {r.name: (r.match, round(r.similarity, 9)) for r in E.fuzzy_match(ldf, rdf, "n", thr).collect()}
        assert got == want


def test_dedupe_ties_keep_first(spark):
    rows = [("a", 1, 2.0, None, 5), ("a", 1, None, 3.0, 4), ("a", 1, None, None, 1), ("b", 1, 1.0, 1.0, 9)]
    df = spark.createDataFrame(rows, "e string, p int, x double, y double, ord int")
    out = E.dedupe_most_complete(df, ["e", "p"], ["x", "y"], ["ord"])
    assert sorted(r.ord for r in out.collect()) == [4, 9]


def test_canonicalize_statuses(spark):
    df = spark.createDataFrame([("  A JSC ",), ("gone",), ("New  b*",), ("Total",), ("Insolvent banks",), (None,)], "n string")
    mapping = spark.createDataFrame([("A JSC", "A"), ("gone", None)], "variant string, canonical string")
    got = {r.n: (r.name_status, r.canonical) for r in E.canonicalize(df, "n", mapping).collect()}
    assert got["  A JSC "] == ("mapped", "A")
    assert got["gone"] == ("removed", None)
    assert got["New  b*"] == ("unmapped", "New b")
    assert got["Total"][0] == got["Insolvent banks"][0] == got[None][0] == "removed"


def test_consolidate_fills_only_missing_periods(spark):
    rows = [("A", 1, 1.0), ("JSC A", 1, 9.0), ("JSC A", 2, 2.0), ("B", 1, 5.0)]
    df = spark.createDataFrame(rows, "n string, p int, v double")
    groups = spark.createDataFrame([("JSC A", "A")], "variant string, canonical string")
    out = sorted(tuple(r) for r in E.consolidate(df, "n", "p", groups, ["v"]).collect())
    assert out == [("A", 1, 1.0), ("A", 2, 2.0), ("B", 1, 5.0)]


def test_problem_entities(spark):
    rows = [("JSС Ukr", 5), ("abc", 5), ("12345", 5), ("Rare name", 2), ("Good name", 3), ("Some PJSC x", 9)]
    df = spark.createDataFrame([(n, 1) for n, k in rows for _ in range(k)], "n string, present int")
    got = {r.n: r.reasons for r in E.problem_entities(df, "n", "present").collect()}
    assert "Good name" not in got
    assert got["JSС Ukr"] == ["legal_form_prefix"] and got["Rare name"] == ["few_periods"]
    assert got["Some PJSC x"] == ["legal_form_inside"] and got["12345"] == ["short_or_numeric"]


def test_fuzzy_match_of_names_with_a_long_common_part(spark):
    import random

    rng = random.Random(3)
    numbers = rng.sample(range(10**7), 900)
    right = [f"joint stock bank {n:07d}" for n in numbers] + ["ab", "abc", "short name"]
    left = []
    for n in numbers[:300]:
        s = list(f"joint stock bank {n:07d}")
        for _ in range(rng.choice([0, 1, 2, 3])):
            s[rng.randrange(17, len(s))] = rng.choice("0123456789x")
        left.append("".join(s))
    left += ["abd", "short nmae", "nothing alike"]
    L, R = (spark.createDataFrame([(x,) for x in xs], "n string") for xs in (left, right))
    got = {r.name: (r.match, round(r.similarity, 9)) for r in E.fuzzy_match(L, R, "n", 0.8).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    def key(name):
        return " ".join(sorted(name.split()))

    for name in set(left[:40] + left[-3:]):
        best = max((round(1 - distance(key(name), key(m)) / max(len(name), len(m)), 9) for m in right), default=0)
        assert got[name][1] == best if best >= 0.8 else name not in got
