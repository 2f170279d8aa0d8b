"""Counts and grade levels of a text, all from built-in functions."""

from __future__ import annotations

from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

# The coefficients of the two published formulas.
FLESCH_KINCAID = (0.39, 11.8, -15.59)
AUTOMATED_READABILITY = (4.71, 0.5, -21.43)


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z0-9]++"))


def sentences(text: Column) -> Column:
    return F.greatest(F.regexp_count(text, F.lit("[.!?]++")), F.lit(1))


def characters(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, ascii_letters + digits, ""))


def syllables(text: Column) -> Column:
    """Vowel groups, and one for each word that has none: the words less those that match from their first vowel on."""
    vowel = "[AEIOUYaeiouy]"
    with_vowel = F.regexp_count(text, F.lit(f"{vowel}[A-Za-z0-9]*+"))
    return F.regexp_count(text, F.lit(f"{vowel}++")) + words(text) - with_vowel


def flesch_kincaid(text: Column) -> Column:
    """Null for a text without words."""
    per_sentence, per_word, base = FLESCH_KINCAID
    n = F.nullif(words(text), F.lit(0)).cast("double")
    return F.lit(per_sentence) * (n / sentences(text)) + F.lit(per_word) * (syllables(text) / n) + F.lit(base)


def automated_readability(text: Column) -> Column:
    """Null for a text without words."""
    per_word, per_sentence, base = AUTOMATED_READABILITY
    n = F.nullif(words(text), F.lit(0)).cast("double")
    return F.lit(per_word) * (characters(text) / n) + F.lit(per_sentence) * (n / sentences(text)) + F.lit(base)
