"""Toxicity by weak supervision.

Many voters look at a text: lexicons of insults, lexicons of terms (words and
beginnings of words) mined from labelled rows, and patterns such as shouting.
Each says yes or no.  A generative label model learns from the votes on all
documents, without labels, how often each voter is right, and which voters agree
beyond what a common cause explains; such voters share their weight.  The
posterior labels of a sample train a linear classifier on the terms' rates and
presence, which scores whole texts.

Scale.  Mining, thresholds and the classifier use at most about ``FIT_ROWS``
labelled rows, drawn by a hash of their id; a label that repeats gives one row.
The label model covers all documents: votes are one bit mask per text, so there
are at most 2^16 of them, counted with partial sums; equal texts count once.  One
pass counts votes, one scores.

Defined results.  Null and empty texts have no term; their score is the
classifier's intercept.  Labels other than 0 and 1, and rows without doc_id, teach
nothing; contradicting labels of one doc_id count as toxic.  Repeated rows are
scored alike.  Without any labelled row the insult lexicons and patterns still
vote.  An empty table gives no rows.  Further columns do not count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.registry import query, table
from tessella.session import materialize

FIT_ROWS = 20_000
VOCABULARY, LEXICON_TERMS = 1_024, 240
PREFIXES = (3, 4, 5, 6, 7)
FOLDS = 5

# Common English insults, as two lexicons.
INSULTS = (
    ("idiot", "moron", "imbecile", "stupid", "dumb", "fool", "clown", "jerk", "loser", "liar", "coward", "creep", "freak", "psycho"),
    ("trash", "garbage", "scum", "filth", "vermin", "worthless", "pathetic", "disgusting", "ugly", "useless", "hideous", "degenerate", "subhuman"),
)
# End of fixed values.

MINED = 10
PATTERNS = ("shouting", "exclaiming", "repeating", "masking")
VOTERS = len(INSULTS) + MINED + len(PATTERNS)
_WORD, _MASKED = re.compile(r"\w+"), re.compile(r"[#$%&*@]{2,}")
_KEPT = 200_000


def terms(word: str) -> list[str]:
    """A word and its beginnings (marked by a trailing hyphen)."""
    return [word, *[f"{word[:k]}-" for k in PREFIXES if k < len(word)]]


class Reader:
    """Counts of known terms and pattern hits of texts, with words cached."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.vocabulary = vocabulary
        self.cache: dict[str, tuple[list[int], bool]] = {}

    def word(self, word: str) -> tuple[list[int], bool]:
        got = self.cache.get(word)
        if got is None:
            found = [self.vocabulary[t] for t in terms(word.lower()) if t in self.vocabulary]
            got = found, len(word) > 2 and word.isupper()
            if len(self.cache) < _KEPT and len(word) < 50:
                self.cache[word] = got
        return got

    def __call__(self, text: str) -> tuple[dict[int, int], list[int], int]:
        """Counts by term, hits by pattern, words."""
        words = _WORD.findall(text)
        counts: dict[int, int] = {}
        shouted = 0
        for w, n in Counter(words).items():
            found, upper = self.word(w)
            if upper:
                shouted += n
            for t in found:
                counts[t] = counts.get(t, 0) + n
        repeated = sum(map(eq, words, islice(words, 1, None)))
        return counts, [shouted, text.count("!!"), repeated, len(_MASKED.findall(text))], len(words)


# ------------------------------------------------------------------- mining


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per term and label, added up within the task while they fit."""

    def flush() -> pa.RecordBatch:
        keys = set(counts[0]) | set(counts[1])
        cols = [pa.array(keys, pa.string()), *[pa.array([c[k] for k in keys], pa.int64()) for c in counts]]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(cols, ["term", "clean", "toxic"])

    counts = (Counter(), Counter())
    for b in batches:
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            words = {w.lower() for w in _WORD.findall(text or "")}
            counts[toxic].update({t for w in words for t in terms(w)})
            if len(counts[0]) + len(counts[1]) > 400_000:
                yield flush()
    if counts[0] or counts[1]:
        yield flush()


def mine(sample: DataFrame, rows: dict[int, int]) -> tuple[list[str], list[str]]:
    """Terms for the lexicons, and the classifier's vocabulary, from labelled rows.

    Both are ranked by how sure the difference between the classes is; a lexicon's
    term is three times as frequent among toxic rows at least.  Lexicon terms come by
    falling precision, so that lexicons of sure terms stand apart from others.
    """
    counts = sample.select("text", "toxic").mapInArrow(_term_counts, "term string, clean long, toxic long")
    counts = counts.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    ratio = F.log(t / (rows.get(1, 0) + 1)) - F.log(c / (rows.get(0, 0) + 1))
    ranked = counts.where(F.col("toxic") + F.col("clean") >= 3).select("term", ratio.alias("ratio"), (ratio / F.sqrt(1 / t + 1 / c)).alias("z"))
    ranked = materialize(ranked, "toxicity-terms")
    lexicon = ranked.where(F.col("ratio") >= float(np.log(3))).orderBy(F.desc("z"), "term").limit(LEXICON_TERMS)
    vocabulary = ranked.orderBy(F.desc(F.abs("z")), "term").limit(VOCABULARY)
    return [r["term"] for r in lexicon.orderBy(F.desc("ratio"), "term").collect()], [r["term"] for r in vocabulary.collect()]


# ------------------------------------------------------------------- voters


@dataclass
class Voters:
    """Lexicons as sets of term numbers, and the rate from which each voter says yes."""

    vocabulary: dict[str, int]
    lexicons: list[frozenset[int]]
    least: np.ndarray

    def rates(self, read: tuple[dict[int, int], list[int], int]) -> np.ndarray:
        """Hits of each voter over the root of the words."""
        counts, patterns, words = read
        hits = [sum(n for t, n in counts.items() if t in lexicon) if counts else 0 for lexicon in self.lexicons] + patterns
        return np.array(hits, float) / max(words, 1) ** 0.5

    def mask(self, read: tuple[dict[int, int], list[int], int]) -> int:
        return int(((self.rates(read) >= self.least) << np.arange(VOTERS)).sum())


def voters(lexicon: list[str], vocabulary: list[str]) -> Voters:
    """Insult lexicons, mined lexicons (two halves by precision, each dealt by rank), patterns."""
    known = {t: i for i, t in enumerate(dict.fromkeys([*vocabulary, *lexicon, *[w for words in INSULTS for w in words]]))}
    lexicons = [frozenset(known[w] for w in words) for words in INSULTS]
    half = (len(lexicon) + 1) // 2
    for part in (lexicon[:half], lexicon[half:]):
        lexicons += [frozenset(known[t] for t in part[k :: MINED // 2]) for k in range(MINED // 2)]
    return Voters(known, lexicons, np.full(VOTERS, np.inf))


def _rates(v: Voters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(v.vocabulary)
        for b in batches:
            rates = [v.rates(reader(t or "")).tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rates, pa.list_(pa.float64())), b.column("toxic")], ["rates", "toxic"])

    return run


def thresholds(rates: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per voter the rate that best parts the classes, and its yes rates by class."""
    least = np.full(VOTERS, np.inf)
    said = np.full((VOTERS, 2), 0.01)
    for k in range(VOTERS):
        positive = rates[rates[:, k] > 0, k]
        if not len(positive) or not toxic.any() or toxic.all():
            least[k] = 1e-9  # any hit
            said[k] = 0.02, 0.5
            continue
        cuts = np.unique(np.quantile(positive, np.linspace(0, 0.98, 50)))
        yes = rates[:, k, None] >= cuts
        rate = np.stack([(yes[toxic == c].sum(0) + 0.5) / ((toxic == c).sum() + 1) for c in (0, 1)])
        best = int(np.argmax(rate[1] - rate[0]))
        least[k], said[k] = cuts[best], rate[:, best]
    return least, said


# ------------------------------------------------------------------- label model


@dataclass
class LabelModel:
    """Prior, yes rates (voter, class), correlations given the class, weights."""

    prior: float
    said: np.ndarray
    correlation: np.ndarray
    weight: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        s = np.clip(self.said, 1e-4, 1 - 1e-4)
        yes, no = np.log(s[:, 1] / s[:, 0]), np.log((1 - s[:, 1]) / (1 - s[:, 0]))
        odds = np.log(self.prior / (1 - self.prior)) + np.where(votes, yes, no) @ self.weight
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def label_model(votes: np.ndarray, n: np.ndarray, prior: float, said: np.ndarray, rounds: int = 60) -> LabelModel:
    """Expectation maximisation over vote patterns that occur ``n`` times.

    Each round estimates yes rates per class and the correlations that remain
    within classes; a voter with correlated others is weighted by one over one plus
    their sum, so a group of echoes counts about as one voice.
    """
    model = LabelModel(prior, said.copy(), np.zeros((VOTERS, VOTERS)), np.ones(VOTERS))
    if not n.sum():
        return model
    x = votes.astype(float)
    for _ in range(rounds):
        p = model.posterior(votes)
        total, left = np.zeros((VOTERS, VOTERS)), 0.0
        for c, q in ((0, (1 - p) * n), (1, p * n)):
            mass = q.sum() + 2
            model.said[:, c] = (q @ x + 2 * said[:, c]) / mass  # two rows' worth of the first estimate
            d = x - model.said[:, c]
            total += (d * q[:, None]).T @ d
            left += q.sum()
        cov = total / max(left, 1)
        sd = np.sqrt(np.diag(cov)) + 1e-9
        model.correlation = cov / np.outer(sd, sd)
        shared = np.where(model.correlation > 0.1, model.correlation, 0) - np.diag(np.diag(model.correlation))
        model.weight = 1 / (1 + np.clip(shared, 0, None).sum(1))
    return model


# ------------------------------------------------------------------- classifier


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, n: int, penalty: float = 1e-4, steps: int = 400) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradients; the last
    weight is the intercept."""
    x = np.zeros((len(rows), n + 1), np.float32)
    for i, (at, values) in enumerate(rows):
        x[i, at] = values
    x[:, n] = 1
    w = np.zeros(n + 1, np.float32)
    ahead, speed = w.copy(), 1.0
    step = 4 / float((x * x).sum(1).mean() + 1e-9)
    keep = np.full(n + 1, penalty, np.float32)
    keep[n] = 0
    loss_before = np.inf
    for _ in range(steps):
        z = x @ ahead
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        loss = float(np.mean(np.logaddexp(0, z) - target * z) + 0.5 * (keep * ahead * ahead).sum())
        if loss > loss_before:
            speed, ahead = 1.0, w.copy()
            loss_before = np.inf
            continue
        loss_before = loss
        gradient = x.T @ (p - target).astype(np.float32) / len(rows) + keep * ahead
        new = ahead - step * gradient
        following = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead, w, speed = new + np.float32((speed - 1) / following) * (new - w), new, following
    return w


def width(v: Voters) -> int:
    """Features of a text: rate and presence of each term, rates of patterns."""
    return 2 * len(v.vocabulary) + len(PATTERNS)


def features(v: Voters, read: tuple[dict[int, int], list[int], int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of a text's features that are not zero."""
    counts, patterns, words = read
    n, root = len(v.vocabulary), np.float32(max(words, 1) ** 0.5)
    at = np.fromiter(counts, np.int64, len(counts))
    rates = np.fromiter(counts.values(), np.float32, len(counts)) / root
    own = np.arange(2 * n, 2 * n + len(PATTERNS))
    values = [rates, np.full(len(at), 0.25, np.float32), np.array(patterns, np.float32) / root]
    return np.concatenate([at, at + n, own]), np.concatenate(values).clip(0, 2)


def _train_task(v: Voters, label: LabelModel):
    """Training as one task over the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rows, masks = Reader(v.vocabulary), [], []
        for b in batches:
            for text in b.column("text").to_pylist():
                read = reader(text or "")
                rows.append(features(v, read))
                masks.append(v.mask(read))
        target = label.posterior((np.array(masks)[:, None] >> np.arange(VOTERS) & 1).astype(bool)) if rows else np.zeros(0)
        weights = train(rows, target.astype(np.float32), width(v)) if rows else np.zeros(1)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(float).tolist()], pa.list_(pa.float64()))], ["weights"])

    return run


# ------------------------------------------------------------------- operator


def held_out(doc_id: Column) -> Column:
    """Rows that teach nothing: one fifth by a checksum of the id, and rows without id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


@dataclass
class Model:
    """What is learned: voters, label model and weights."""

    voters: Voters
    label: LabelModel
    weights: np.ndarray


def _sampled(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """doc_id, text and toxic of about ``fit_rows`` labelled rows at most."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, fit_rows / max(known.count(), 1))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    known = known.select(F.col("doc_id").alias("id"), "toxic")
    rows = docs.join(F.broadcast(known), F.col("doc_id") == F.col("id"))  # the labels of about fit_rows ids
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))


def _masks(v: Voters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(v.vocabulary)
        for b in batches:
            masks = [v.mask(reader(t or "")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(masks, pa.int32()), b.column("h1"), b.column("h2")], ["mask", "h1", "h2"])

    return run


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """Learn from ``labels`` (doc_id, toxic) and the texts of all ``docs``."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sample = materialize(_sampled(docs, labels.select("doc_id", "toxic"), fit_rows), "toxicity-sample")
    rows = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    v = voters(*mine(sample, rows))
    seen = sample.select("text", "toxic").mapInArrow(_rates(v), "rates array<double>, toxic int").collect()  # sixteen numbers a sampled row
    v.least, said = thresholds(np.array([r["rates"] for r in seen]).reshape(-1, VOTERS), np.array([r["toxic"] for r in seen], int))
    prior = (rows.get(1, 0) + 1) / (sum(rows.values()) + 10)
    told = docs.select("text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    told = told.mapInArrow(_masks(v), "mask int, h1 long, h2 long").distinct().groupBy("mask").agg(F.count(F.lit(1)).alias("n"))
    counted = sorted((r["mask"], r["n"]) for r in told.collect())  # 2^16 masks at most
    masks, n = np.array([m for m, _ in counted], int), np.array([k for _, k in counted], float)
    label = label_model((masks[:, None] >> np.arange(VOTERS) & 1).astype(bool), n, prior, said)
    got = sample.select("text").coalesce(1).sortWithinPartitions("text").mapInArrow(_train_task(v, label), "weights array<double>").first()
    return Model(v, label, np.array(got["weights"] if got else [0.0]))


def _scored(model: Model):
    w, v = model.weights, model.voters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(v.vocabulary)
        for b in batches:
            scores = []
            for text in b.column("text").to_pylist():
                at, values = features(v, reader(text or ""))
                z = float(w[at] @ values + w[-1]) if len(w) > 1 else 0.0
                scores.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and predicted of every row."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    t = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.mapInArrow(_scored(model), f"doc_id {t}, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


@query("op13_toxicity")
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from four fifths of the labels."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
