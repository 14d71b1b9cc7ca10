"""Text rules as column functions (X-family)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that look alike in two scripts, and ligatures.
LOOK_ALIKE = ("асеорхукмнвт", "aceopxykmhbt")
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}


def normalize_text(text: Column) -> Column:
    """X-01 without composition: control and zero-width marks out, ligatures apart, line-end hyphens joined, blanks to one space."""
    for lig, plain in LIGATURES.items():
        text = F.replace(text, F.lit(lig), F.lit(plain))
    text = F.regexp_replace(text, r"[\x{00AD}\x{200B}\x{200C}\x{200D}\x{FEFF}\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    text = F.regexp_replace(text, r"(\p{L})-\r?\n(\p{Ll})", "$1$2")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _compose(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def composed(text: Column) -> Column:
    """NFC: Spark has no such function, so this one step runs in Arrow batches."""
    return F.pandas_udf(_compose, "string")(text)


def norm_key(text: Column) -> Column:
    """X-03: letters and digits in lower case, ё as е, look-alikes in one script."""
    return F.translate(F.regexp_replace(F.translate(F.lower(text), "ё", "е"), r"[^\p{L}\p{N}]+", ""), *LOOK_ALIKE)


def words(text: Column, pattern: str = r"[^\p{L}\p{N}]+") -> Column:
    return F.filter(F.split(F.lower(text), pattern), lambda w: w != "")


def sentences(text: Column) -> Column:
    """X-04: cut behind a terminal mark and blanks."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


def letters(text: Column, script: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{script}]", ""))


def language_majority(text: Column) -> Column:
    """X-07: by letters, two to one."""
    cyr, lat = letters(text, "А-Яа-яЁё"), letters(text, "A-Za-zÄÖÜäöüß")
    return F.when(cyr > 2 * lat, "cyrillic").when(lat > 2 * cyr, "latin").otherwise("mixed")


def stem(word: Column) -> Column:
    """X-06: a common ending off, if four letters stay."""
    return F.regexp_replace(word, r"^(.{4,}?)(?:ings?|edly|ed|ies|es|s|ung|ungen|en|er|иями|ями|ами|ого|его|ому|ему|ыми|ими|ость|ости|ения|ение|ая|яя|ое|ее|ые|ие|ый|ий|ой|ах|ях|ов|ев|ам|ям|ом|ем|а|я|ы|и|у|ю|е|о)$", "$1")


def shingles(tokens: Column, n: int) -> Column:
    """Runs of n words as texts; none if there are fewer."""
    at = F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1)))
    return F.when(F.size(tokens) >= n, F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def redacted(text: Column) -> Column:
    """X-27: addresses, tokens and home folders out."""
    for pattern, mark in ((r"[\w.+-]+@[\w-]+\.[\w.]+", "[mail]"), (r"(?i)\b(?:key|token|secret|password)\s*[=:]\s*\S+", "[secret]"), (r"/(?:home|Users)/[^/\s]+", "[home]")):
        text = F.regexp_replace(text, pattern, mark)
    return text
