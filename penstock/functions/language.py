"""The dominant script of a text, and the language it stands for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Script -> language.
SCRIPTS = {"Latin": "en", "Greek": "el", "Cyrillic": "ru", "Arabic": "ar", "Hebrew": "he", "Han": "zh", "Hiragana": "ja", "Katakana": "ja", "Hangul": "ko", "Thai": "th", "Devanagari": "hi"}


def detect_language(text: Column | str) -> Column:
    """By the script with most letters, the first of the table where they tie; null without letters."""
    t = F.col(text) if isinstance(text, str) else text
    counts = [F.struct((F.length(t) - F.length(F.regexp_replace(t, rf"\p{{Is{s}}}", ""))).alias("n"), F.lit(-i).alias("o"), F.lit(lang).alias("lang")) for i, (s, lang) in enumerate(SCRIPTS.items())]
    best = F.greatest(*counts)
    return F.when(best["n"] > 0, best["lang"])


def display_name(original: Column, normalized: Column, lang: str | None = None) -> Column:
    """The normalised name for English readers, else the original one; whichever is there."""
    return F.coalesce(F.nullif(normalized, F.lit("")), original) if lang in ("en", None) else F.coalesce(F.nullif(original, F.lit("")), normalized)
