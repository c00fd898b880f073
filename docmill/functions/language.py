"""The language of a document as a column: which language's small words its words are. A light stand-in for a language
model in ingestion; texts are judged by their first characters, as a label for the whole."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.text import LETTER, SPACE

#: How much of a text is looked at, and the least a language is named for (fixed values).
MOST_CHARACTERS, LEAST_CHARACTERS = 4000, 20
WORDS = 80  # small words kept of each language


def small_words(samples: list[tuple[str, str]]) -> dict[str, list[str]]:
    """The most frequent short words of each language of (language, text), without those that all languages share."""
    seen: dict[str, Counter] = {}
    for lang, text in samples:
        seen.setdefault(lang, Counter()).update(w for w in re.findall(r"[^\W\d_]+", text.lower()) if len(w) <= 5)
    shared = set.intersection(*(set(c) for c in seen.values())) if len(seen) > 1 else set()
    return {lang: sorted(w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0])) if w not in shared)[:WORDS] for lang, c in sorted(seen.items())}


def is_one_of(own: list[str]) -> Callable[[Column], Column]:
    return lambda token: token.isin(*own)


def language_of(text: Column, words: dict[str, list[str]]) -> Column:
    """struct<code, confidence> of a text: the language most of its small words are of, and their share among all
    languages' hits; null for a text that is too short or has none."""
    flat = F.substring(F.trim(F.regexp_replace(text, f"[{SPACE}]+", " ")), 1, MOST_CHARACTERS)
    tokens = F.regexp_extract_all(F.lower(flat), F.lit(f"[{LETTER}]+"), F.lit(0))
    hits = [F.size(F.filter(tokens, is_one_of(own))) for own in words.values()]
    if not hits:
        return F.lit(None).cast("struct<code string, confidence double>")
    best = F.greatest(F.struct(F.lit(0).alias("n"), F.lit("").alias("code")), *[F.struct(h.alias("n"), F.lit(lang).alias("code")) for h, lang in zip(hits, words)])
    total = sum(hits[1:], hits[0])
    return F.when((F.length(flat) >= LEAST_CHARACTERS) & (best["n"] > 0), F.struct(best["code"].alias("code"), F.round(best["n"] / total, 3).alias("confidence")))
