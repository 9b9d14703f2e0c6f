"""Porter's stemmer (1980, with its author's later departures) for lower-case words."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..ship import ship

# Suffixes and what stands in for them, steps 2, 3 and 4 of the published algorithm.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
#: Words outside these lengths stay as they are.
SHORTEST, LONGEST = 3, 64


def _shape(word: str) -> str:
    """v for a vowel, c for another letter; y is a vowel after a consonant."""
    out = ""
    for k, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    """Consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _by_length(table) -> list[tuple[int, dict[str, str]]]:
    """A step's suffixes by their lengths, longest first."""
    return [(n, {s: r for s, r in table if len(s) == n}) for n in sorted({len(s) for s, _ in table}, reverse=True)]


_STEPS = ((_by_length(STEP2), 0), (_by_length(STEP3), 0), (_by_length([(s, "") for s in STEP4]), 1))


def _replaced(word: str, table: list[tuple[int, dict[str, str]]], least: int) -> str:
    """The word with its longest suffix of the table replaced, if what is before it has a measure over `least`."""
    for n, of in table:
        other = of.get(word[-n:])
        if other is not None and len(word) >= n:
            stem = word[:-n]
            return stem + other if _measure(stem) > least and (word[-n:] != "ion" or stem[-1:] in ("s", "t")) else word
    return word


def _inflected(word: str) -> str:
    """Steps 1a to 1c: plurals, -ed, -ing, -y."""
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for suffix in ("ed", "ing"):
            stem = word.removesuffix(suffix)
            if stem != word:
                if "v" in _shape(stem):
                    word = stem
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif _double(word) and word[-1] not in "lsz":
                        word = word[:-1]
                    elif _measure(word) == 1 and _short_end(word):
                        word += "e"
                break
    return word[:-1] + "i" if word.endswith("y") and "v" in _shape(word[:-1]) else word


#: Last characters that no suffix has.
_NEVER = frozenset("abfhjkopqvwxz0123456789")
#: What a word ends in if any step changes it.
_ENDS = ("s", "ed", "ing", "y", "e", "ll", *(x for x, _ in STEP2 + STEP3), *STEP4)


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    if not SHORTEST <= len(word) <= LONGEST or word[-1] in _NEVER or not word.endswith(_ENDS):
        return word
    word = _inflected(word)
    for table, least in _STEPS:
        word = _replaced(word, table, least)
    if word.endswith("e"):
        n = _measure(word[:-1])
        if n > 1 or (n == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def _stems(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


def stemmed(word: Column) -> Column:
    """The stem of a column of lower-case words; null stays null. For distinct words, such as a vocabulary's."""
    ship(SparkSession.active())
    return F.pandas_udf(_stems, StringType())(word)
