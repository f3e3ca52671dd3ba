"""Column expressions for names, noise rows and numeric text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rows whose entity cell matches one of these are no entities.
NOISE_PATTERNS = [
    r"^(?:total|sum|всього|разом)",
    r"^source:",
    r"^note:",
    r"^notes:",
    r"^\*",
    r"^-+$",
    r"^\s*$",
]
NOISE_DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}"

# Cyrillic letters and the Latin letters they look like.
HOMOGLYPH_FROM = "АВСЕНКМОРТХаеосрхіу"
HOMOGLYPH_TO = "ABCEHKMOPTXaeocpxiy"

# What counts as a missing number, and a plain decimal number.
MISSING_MARKERS = ["", "nan", "None", "-"]
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def any_pattern(patterns: list[str]) -> str:
    """One case-insensitive, Unicode-aware alternation."""
    return "(?iu)" + "|".join(f"(?:{p})" for p in patterns)


def is_noise(name: Column, dates: bool = False) -> Column:
    """True for totals, notes, rules, blanks and the text ``nan``."""
    patterns = NOISE_PATTERNS + ([NOISE_DATE_PATTERN] if dates else [])
    text = F.trim(name)
    return name.isNull() | text.rlike(any_pattern(patterns)) | (text == "nan")


def clean_numeric(text: Column, percent: bool = False) -> Column:
    """Numeric text to double; anything that is not a plain number is null."""
    drop = ", %" if percent else ", "
    squeezed = F.translate(text, "−–—" + drop, "---")
    kept = F.when(~squeezed.isin(MISSING_MARKERS) & squeezed.rlike(NUMBER_PATTERN), squeezed)
    return kept.try_cast("double")


def clean_name(name: Column) -> Column:
    """Drop footnote stars and squeeze whitespace."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"\*+", ""), r"(?U)\s+", " "))


def fold_homoglyphs(name: Column) -> Column:
    return F.translate(name, HOMOGLYPH_FROM, HOMOGLYPH_TO)


def normalize_name(name: Column) -> Column:
    """Snake-case a header held in a column (Unicode letters are kept)."""
    steps = [(r"(?U)\s+", "_"), (r"(?U)[^\w.]", "_"), (r"_+", "_"), (r"^_+|_+$", "")]
    out = F.trim(name)
    for pattern, replacement in steps:
        out = F.regexp_replace(out, pattern, replacement)
    return F.lower(out)


def normalize_header(header: str) -> str:
    """Same rule for a column name known on the driver (schema metadata)."""
    words = re.sub(r"[^\w.]+", "_", header.strip())
    return re.sub(r"_+", "_", words).strip("_").lower()


def token_key(name: Column) -> Column:
    """Case-folded tokens in sorted order: equal for reordered names."""
    words = F.split(F.lower(F.trim(name)), r"[^\p{L}\p{N}]+")
    return F.array_join(F.array_sort(F.filter(words, lambda w: w != "")), " ")


def edit_similarity(left: Column, right: Column) -> Column:
    """1 - edit distance / longer length, in [0, 1]."""
    longer = F.greatest(F.length(left), F.length(right))
    return F.lit(1.0) - F.levenshtein(left, right) / F.greatest(longer, F.lit(1))
