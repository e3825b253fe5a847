"""English stems (the Snowball algorithm, version 2) and stop words.

Stemming is a helper for single words.  Columns are stemmed in Arrow batches,
each distinct word of a batch once; callers group equal words beforehand.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that an English full-text index leaves out.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
# The algorithm's word lists and suffixes.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = "sky news howe atlas cosmos bias andes".split()
KEPT_LATER = "inning outing canning herring earring proceed exceed succeed".split()
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": "og", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
#: All but so many last letters of a stem open its word: the longest change is of ``biliti`` to ``ble``.
CHANGED = 2

_FIRST = re.compile("(?:(?:gener|commun|arsen)|[^aeiouy]*[aeiouy]+[^aeiouy])")
_NEXT = re.compile("[^aeiouy]*[aeiouy]+[^aeiouy]")
_SHORT = re.compile("(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_PLAIN = re.compile("[a-z']{3,}")


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words with other letters or digits stay as they are."""
    if not _PLAIN.fullmatch(word) or word in KEPT:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = re.sub("(^|[aeiouy])y", r"\1Y", word.removeprefix("'"))
    first = _FIRST.match(w)
    r1 = first.end() if first else len(w)
    second = _NEXT.match(w, r1)
    r2 = second.end() if second else len(w)
    w = re.sub("('s'|'s|')$", "", w)
    # step 1
    end = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        w = w[:-2]
    elif end in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif end == "s" and re.search("[aeiouy].", w[:-1]):
        w = w[:-1]
    if w in KEPT_LATER:
        return w
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end.startswith("eed"):
        w = w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    elif end and re.search("[aeiouy]", w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif len(w) <= r1 and _SHORT.search(w):
            w += "e"
    w = re.sub("(?<=.[^aeiouy])[yY]$", "i", w)
    # step 2
    end = _longest(w, STEP_2)
    if end and len(w) - len(end) >= r1 and (end != "ogi" or w[-4:-3] == "l") and (end != "li" or w[-3:-2] in tuple("cdeghkmnrt")):
        w = w[: -len(end)] + STEP_2[end]
    # step 3
    end = _longest(w, STEP_3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + STEP_3[end]
    # step 4
    end = _longest(w, STEP_4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    # step 5
    if w.endswith("e") and (len(w) > r2 or (len(w) > r1 and not _SHORT.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stemmed(c: Column) -> Column:
    """Stems of a column of words."""

    @F.pandas_udf("string")
    def stems(s: pd.Series) -> pd.Series:
        kinds = {w: stem(w) for w in s.dropna().unique()}
        return s.map(kinds)

    return stems(c)
