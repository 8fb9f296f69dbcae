"""Porter stemming for the full-text index.

The stemmer is a small per-word helper (Porter, 1980).  It never runs over
the token stream: only the *distinct vocabulary* goes through a Python
worker (Arrow batches via mapInPandas / pandas_udf), and the resulting
term -> stem map is joined back to the partially aggregated postings.
Tokens outside [a-z]{3,64} pass through unchanged.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEMMABLE = re.compile(r"^[a-z]{3,64}$")


def _cons(w: str, i: int) -> bool:
    c = w[i]
    if c in "aeiou":
        return False
    if c == "y":
        return i == 0 or not _cons(w, i - 1)
    return True


def _measure(stem: str) -> int:
    n, i, k = 0, 0, len(stem)
    while i < k and _cons(stem, i):
        i += 1
    while i < k:
        while i < k and not _cons(stem, i):
            i += 1
        if i >= k:
            break
        n += 1
        while i < k and _cons(stem, i):
            i += 1
    return n


def _has_vowel(stem: str) -> bool:
    return any(not _cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    k = len(w)
    return (k >= 3 and _cons(w, k - 3) and not _cons(w, k - 2) and _cons(w, k - 1)
            and w[-1] not in "wxy")


def _rule_step(w: str, rules: list[tuple[str, str]], min_m: int) -> str:
    """Longest listed suffix that matches decides; replaced when the stem's
    measure exceeds ``min_m - 1``; no fallback to shorter suffixes."""
    for suf, rep in rules:
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            return stem + rep if _measure(stem) >= min_m else w
    return w


_STEP2 = sorted([
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
], key=lambda r: -len(r[0]))
_STEP3 = sorted([
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
], key=lambda r: -len(r[0]))
_STEP4 = sorted(["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment",
                 "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"], key=lambda s: -len(s))


def porter_stem(word: str) -> str:
    if not word or not _STEMMABLE.match(word):
        return word
    w = word
    # step 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("ss"):
        pass
    elif w.endswith("s"):
        w = w[:-1]
    # step 1b
    extra = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, extra = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, extra = w[:-3], True
    if extra:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double_cons(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    # step 1c
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _rule_step(w, _STEP2, 1)
    w = _rule_step(w, _STEP3, 1)
    # step 4
    for suf in _STEP4:
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            if _measure(stem) > 1 and (suf != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    # step 5a
    if w.endswith("e"):
        stem = w[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _cvc(stem)):
            w = stem
    # step 5b
    if _measure(w) > 1 and _double_cons(w) and w.endswith("l"):
        w = w[:-1]
    return w


STEMMERS = {"porter": porter_stem}


def stem_map(terms: DataFrame, stemmer: str = "porter", col: str = "term") -> DataFrame:
    """(term, stem) for the distinct terms of ``terms``; Python runs once per
    distinct term, in Arrow batches."""
    fn = STEMMERS[stemmer]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"term": pdf[col], "stem": pdf[col].map(fn)})
    return terms.select(col).distinct().mapInPandas(run, "term string, stem string")


def stem_column(df: DataFrame, col: str, stemmer: str = "porter") -> DataFrame:
    """Stem a string column of a small frame (query terms)."""
    fn = STEMMERS[stemmer]

    @F.pandas_udf("string")
    def stem(s: pd.Series) -> pd.Series:
        return s.map(fn)
    return df.withColumn(col, stem(F.col(col)))
