"""English stems by the published Porter2 rules, worked out once for each distinct term (H7, H9)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The published rules. Suffixes of a step with what takes their place; the longest that fits counts.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
# Words with stems of their own, and words that stay as they are (the second list: after the first step).
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
INVARIANT_LATER = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
# Beginnings after which the first region starts, doubled letters, letters before -li.
LONG_PREFIXES = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"

_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT_END = re.compile("(?:(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_VOWEL = re.compile("[aeiouy]")


def _region(word: str, start: int = 0) -> int:
    """Where the region behind the first non-vowel after a vowel starts."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural(w: str) -> str:
    end = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        return w[:-2]
    if end in ("ied", "ies"):
        return w[:-2] if len(w) > 4 else w[:-1]
    return w[:-1] if end == "s" and _VOWEL.search(w[:-2]) else w


def _past(w: str, r1: int) -> str:
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end is None:
        return w
    left = w[: -len(end)]
    if end.startswith("eed"):
        return left + "ee" if len(left) >= r1 else w
    if not _VOWEL.search(left):
        return w
    if left.endswith(("at", "bl", "iz")):
        return left + "e"
    if left.endswith(DOUBLES):
        return left[:-1]
    return left + "e" if len(left) <= r1 and _SHORT_END.match(left) else left


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2 or word in INVARIANT:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = re.sub("^y|(?<=[aeiouy])y", "Y", word.removeprefix("'"))
    prefix = next((p for p in LONG_PREFIXES if w.startswith(p)), None)
    r1 = len(prefix) if prefix else _region(w)
    r2 = _region(w, r1)
    w = w[: -len(end)] if (end := _longest(w, ("'", "'s", "'s'"))) else w
    w = _plural(w)
    if w in INVARIANT_LATER:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and not _VOWEL.match(w[-2]):
        w = w[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        end = _longest(w, rules)
        if end and len(w) - len(end) >= r1:
            left = w[: -len(end)]
            fits = {"ogi": left.endswith("l"), "li": left[-1:] in LI_ENDINGS and left != "", "ative": len(left) >= r2}
            w = left + rules[end] if fits.get(end, True) else w
    end = _longest(w, STEP_4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _SHORT_END.match(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stems(terms: Column) -> Column:
    """Stems of a column of distinct terms."""

    @F.pandas_udf("string")
    def found(words: pd.Series) -> pd.Series:
        return words.map(stem, na_action="ignore")

    return found(terms)
