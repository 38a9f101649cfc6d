"""The stemmer: suffix rules in the Porter manner, with a measure of its own.

The measure of a stem is half the length, rounded down, of its consonant/vowel form without leading consonants and
trailing vowels; runs of equal letters are not collapsed. Words of fewer than three bytes or with other than a-z stay.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffixes in the order in which they are tried.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
WORD = re.compile("[a-z]{3,}")


def shape(s: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in s:
        vowel = ch in "aeiou" or (ch == "y" and out[-1:] == "c")
        out += "v" if vowel else "c"
    return out


def measure(s: str) -> int:
    return len(shape(s).lstrip("c").rstrip("v")) // 2


def doubled(s: str) -> bool:
    return len(s) > 1 and s[-1] == s[-2] and shape(s)[-1] == "c"


def closed(s: str) -> bool:
    """Consonant, vowel, consonant at the end, the last not w, x or y."""
    return shape(s)[-3:] == "cvc" and s[-1] not in "wxy"


def swapped(word: str, rules: tuple[tuple[str, str], ...]) -> str:
    for suffix, new in rules:
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            return rest + new if measure(rest) > 0 else word
    return word


def inflection(word: str) -> str:
    """Plurals, -ed and -ing."""
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    for ending in ("ed", "ing"):
        if word.endswith(ending):
            rest = word[: -len(ending)]
            if "v" not in shape(rest):
                return word
            if rest.endswith(("at", "bl", "iz")) or (measure(rest) == 1 and closed(rest) and not doubled(rest)):
                return rest + "e"
            return rest[:-1] if doubled(rest) and rest[-1] not in "lsz" else rest
    return word


def derivation(word: str) -> str:
    """The last suffix of the fourth step that applies."""
    for suffix in STEP4:
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            return rest if measure(rest) > 1 else word
    rest = word[:-3]
    return rest if word.endswith("ion") and rest[-1:] in ("s", "t") and measure(rest) > 1 else word


def stem(word: str) -> str:
    if not WORD.fullmatch(word):
        return word
    word = inflection(word)
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = derivation(swapped(swapped(word, STEP2), STEP3))
    if word.endswith("e"):
        rest = word[:-1]
        m = measure(rest)
        if m > 1 or (m == 1 and not closed(rest)):
            word = rest
    return word[:-1] if word.endswith("l") and doubled(word) and measure(word) > 1 else word


def bounded(word: str) -> str:
    """The stem, of at most 64 bytes."""
    return stem(word).encode()[:64].decode("utf-8", "ignore")


@F.pandas_udf(T.StringType())
def stem_terms(terms: pd.Series) -> pd.Series:
    """Stems of at most 64 bytes; meant for distinct terms, joined back."""
    return terms.map(lambda t: None if t is None else bounded(t))
