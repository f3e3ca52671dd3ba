"""Small made-up inputs and plain-Python counterparts for the operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, dropped_id long, host string, kept string"


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(spark, rows):
    """Rows of (doc_id, text[, source]) with further columns that clash with
    names the operators use."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), 1, "h", "x") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def odd_texts(rng: random.Random) -> list:
    return [
        None, "", " ", "\n\n", "a", "é 漢字 \U0001f600 z", "x" * 3000, "\t tab\x0bfeed\r\n end ", " nb\x85sp", "a\x1cb !\x1c",
        prose(rng, 4000), "the same line\n" * 40, "don't we'll  two   three",
    ]
