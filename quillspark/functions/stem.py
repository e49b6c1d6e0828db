"""Porter's suffix stripping (M. F. Porter, An algorithm for suffix stripping, 1980), for English words of ASCII letters."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Suffixes and what replaces them where the measure of the stem is above 0 (steps 2 and 3), or 1 (step 4).
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(w: str) -> str:
    out = ""
    for i, c in enumerate(w):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c", _shape(w)))


def _short_end(w: str) -> bool:
    """Ends in consonant, vowel, consonant, the last of which isn't w, x or y."""
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _replaced(w: str, rules: dict[str, str]) -> str:
    """By the longest suffix that fits."""
    for suffix in sorted(rules, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + rules[suffix] if _measure(stem) > 0 else w
    return w


@lru_cache(maxsize=100_000)
def stem(w: str) -> str:
    """The stem of a lower-case word; words of one or two letters, or with others than a to z, stay."""
    if len(w) < 3 or not re.fullmatch("[a-z]+", w):
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if cut and "v" in _shape(w[:-cut]):
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, STEP_2), STEP_3)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if w.endswith(suffix):
            rest = w[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
                w = rest
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@pandas_udf(StringType())
def stemmed(words: pd.Series) -> pd.Series:
    """Stems; each different word of a batch is stemmed once."""
    return words.map({w: stem(w) for w in words.dropna().unique()})
