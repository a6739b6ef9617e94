"""Porter stems of the vocabulary, after diacritics are folded.

The algorithm is the published one (M. F. Porter, 1980). Tokens under three or over 64 bytes stay as they are.
Stems are computed once for each distinct term and joined back, never per occurrence.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The suffix tables of steps 2, 3 and 4.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("ement", "ment", "able", "ible", "ance", "ence", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")


def fold(token: str) -> str:
    """Drops the marks of letters that are a base letter and marks."""
    return "".join(c for c in unicodedata.normalize("NFD", token) if not unicodedata.combining(c))


def _shape(word: str) -> str:
    """c for each consonant and v for each vowel; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _shape(stem).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swap(word: str, table: tuple[tuple[str, str], ...]) -> str:
    for old, new in sorted(table, key=lambda t: -len(t[0])):
        if word.endswith(old):
            stem = word[: -len(old)]
            return stem + new if _measure(stem) > 0 else word
    return word


def stem(token: str) -> str:
    w = fold(token)
    if not 3 <= len(w.encode()) <= 64:
        return w
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    cut = ""
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and "v" in _shape(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and "v" in _shape(w[:-3]):
        cut = w[:-3]
    if cut:
        if cut.endswith(("at", "bl", "iz")) or (not _double(cut) and _measure(cut) == 1 and _short(cut)):
            cut += "e"
        elif _double(cut) and cut[-1] not in "lsz":
            cut = cut[:-1]
        w = cut
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP_2), STEP_3)
    for end in STEP_4:
        if w.endswith(end):
            head = w[: -len(end)]
            if _measure(head) > 1 and (end != "ion" or head.endswith(("s", "t"))):
                w = head
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def stem_column(term: Column) -> Column:
    """Stems by Arrow batches; use it on distinct terms only."""

    @F.pandas_udf("string")
    def stems(terms: pd.Series) -> pd.Series:
        return terms.map(stem, na_action="ignore")

    return stems(term)
