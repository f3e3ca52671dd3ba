"""Weak supervision: parts on made-up votes and texts, accuracy on held-out rows."""

import random
import zlib

import numpy as np
import pytest

from tessella.llm import toxicity
from tessella.llm.registry import table

from .made import documents, odd_texts, prose


def test_label_model_finds_accuracies_and_echoes():
    rng = np.random.default_rng(3)
    n, k = 40_000, toxicity.VOTERS
    y = rng.random(n) < 0.1
    said = np.stack([np.full(k, 0.03), np.linspace(0.3, 0.8, k)], 1)
    votes = rng.random((n, k)) < np.where(y[:, None], said[:, 1], said[:, 0])
    for echo in (1, 2, 3):
        votes[:, echo] = np.where(rng.random(n) < 0.95, votes[:, 0], votes[:, echo])
    model = toxicity.label_model(votes, np.ones(n), 0.1, np.stack([np.full(k, 0.1), np.full(k, 0.5)], 1))
    assert np.abs(model.said[4:] - said[4:]).max() < 0.05
    assert model.correlation[0, 1] > 0.5 > 0.1 > abs(model.correlation[6, 9])
    assert model.weight[:4].max() < 0.5 < 0.8 < model.weight[4:].min()
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.97


def test_equal_votes_by_count_are_equal_votes_by_row():
    rng = np.random.default_rng(5)
    votes = rng.random((500, toxicity.VOTERS)) < 0.2
    said = np.stack([np.full(toxicity.VOTERS, 0.1), np.full(toxicity.VOTERS, 0.6)], 1)
    once = toxicity.label_model(votes, np.full(500, 3.0), 0.2, said)
    thrice = toxicity.label_model(np.repeat(votes, 3, 0), np.ones(1500), 0.2, said)
    assert np.allclose(once.said, thrice.said) and np.allclose(once.weight, thrice.weight)


def test_regression_on_soft_labels():
    rng = np.random.default_rng(7)
    x = rng.random((3000, 5)).astype(np.float32)
    target = 1 / (1 + np.exp(-(4 * x[:, 0] - 3 * x[:, 1] - 0.5)))
    w = toxicity.train([(np.arange(5), r) for r in x], target.astype(np.float32), 5, penalty=0, steps=3000)
    assert np.abs(w - [4, -3, 0, 0, 0, -0.5]).max() < 0.1


def test_reader_counts_as_plain_loops_do():
    rng = random.Random(1)
    vocabulary = {t: i for i, t in enumerate(["w1", "w1-", "wor-", "word", "words-", "trash"])}
    read = toxicity.Reader(vocabulary)
    for text in ["word Words WORDSMITH trash!! trash ##%% w11", "", *[t or "" for t in odd_texts(rng)], prose(rng, 50)]:
        counts, patterns, n = read(text)
        words = toxicity._WORD.findall(text)
        want = {}
        for w in words:
            for t in toxicity.terms(w.lower()):
                if t in vocabulary:
                    want[vocabulary[t]] = want.get(vocabulary[t], 0) + 1
        assert (counts, n) == (want, len(words))
        assert patterns[0] == sum(len(w) > 2 and w.isupper() for w in words)
        assert patterns[2] == sum(a == b for a, b in zip(words, words[1:]))


@pytest.fixture(scope="module")
def rated(spark):
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 200))]
        if toxic:
            for _ in range(rng.randrange(3, 9)):
                words[rng.randrange(len(words))] = rng.choice(["grumblix", "snarvex", "idiot", f"zorg{rng.randrange(40)}"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1 - int(toxic) if rng.random() < 0.03 else int(toxic), int(toxic), "x"))
    labels += [(1, None, 0, "x"), (2, 7, 0, "x"), (None, 1, 1, "x"), (99_999, 1, 1, "x")]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, truth int, text string")


def test_held_out_rows_are_told_apart(spark, rated):
    docs, labels = rated
    model = toxicity.fit(docs, labels)
    truth = {r["doc_id"]: r["truth"] for r in labels.collect() if r["doc_id"] is not None}
    got = [(r["predicted"], truth[r["doc_id"]]) for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(got) > 60 and sum(p == t for p, t in got) / len(got) > 0.95


def test_held_out_labels_teach_nothing(spark, rated):
    docs, labels = rated
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert a.voters.vocabulary == b.voters.vocabulary and np.array_equal(a.weights, b.weights)


def test_odd_rows(spark, rated):
    docs, labels = rated
    rng = random.Random(2)
    odd = documents(spark, [*enumerate(odd_texts(rng)), (None, "idiot trash scum"), (None, None), (5, "same"), (5, "same")])
    model = toxicity.fit(docs.unionByName(odd), labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 5}) <= 2  # the odd text of that id, and one score for equal rows
    nothing = toxicity.fit(docs.where("false"), labels)
    assert toxicity.score(docs.where("false"), nothing).collect() == []
    unlabelled = toxicity.fit(docs, labels.where("false"))
    assert toxicity.score(docs, unlabelled).count() == 600


def test_a_smaller_sample_is_drawn_by_rate(spark, rated):
    docs, labels = rated
    n = toxicity._sampled(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), 100).count()
    assert 60 < n < 140


def test_accuracy_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op13_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in got)
    assert len(got) > 60 and right / len(got) > 0.9
