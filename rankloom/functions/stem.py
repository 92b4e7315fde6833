"""Suffix stripping for English words after Porter's published rules (1980), all five steps."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType

#: The suffixes of steps 2 to 4 and what they become, longest first where one ends in another.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """A letter of c or v for each letter; y is a vowel behind a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _replaced(word: str, table: dict[str, str], least: int = 1) -> str:
    """The longest suffix of the table that fits, replaced if what is left is long enough."""
    end = max((e for e in table if word.endswith(e)), key=len, default=None)
    return word if end is None or _measure(word[: -len(end)]) < least else word[: -len(end)] + table[end]


def stem(word: str | None) -> str | None:
    if word is None or len(word) < 3:
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        end = next((e for e in ("ed", "ing") if w.endswith(e) and "v" in _shape(w[: -len(e)])), None)
        if end:
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, STEP_2), STEP_3)
    end = max((e for e in STEP_4 if w.endswith(e)), key=len, default=None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def stems(words: Column) -> Column:
    """Stems of an array of words; each distinct word of a batch is stemmed once."""

    def run(lists: pd.Series) -> pd.Series:
        known: dict[str | None, str | None] = {}

        def one(t):
            if t not in known:
                known[t] = stem(t)
            return known[t]

        return lists.map(lambda x: None if x is None else [one(t) for t in x])

    return F.pandas_udf(run, "array<string>", functionType=PandasUDFType.SCALAR)(words)
