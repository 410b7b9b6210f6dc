"""Syllable checks and splitting of fused given names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicon import fixed

ONSETS = "|".join(sorted(fixed.ONSETS, key=len, reverse=True))
RIMES = "|".join(sorted(fixed.RIMES, key=len, reverse=True))
SYLLABLE = f"^(?:{ONSETS})?(?:{RIMES})$"
FORBIDDEN = "|".join(fixed.FORBIDDEN)


def valid_phonetics(token: Column) -> Column:
    """1 to 7 letters, none of the clusters that no syllable has, and a single letter or an onset with a rime."""
    t = F.lower(token)
    n = F.length(t)
    return (n >= 1) & (n <= 7) & ~t.rlike("[0-9']") & ~t.rlike(FORBIDDEN) & ((n == 1) | t.rlike(SYLLABLE))


def plausible_syllable(token: Column) -> Column:
    """Phonetically valid, or letters with a vowel and no run of four consonants."""
    t = F.lower(token)
    loose = t.rlike(r"^\p{L}+$") & t.rlike("[aeiouü]") & ~t.rlike("[^aeiouü]{4}")
    return (F.length(t) >= 1) & (F.length(t) <= 7) & ~t.rlike(FORBIDDEN) & (valid_phonetics(token) | loose)
