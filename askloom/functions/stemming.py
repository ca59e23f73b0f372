"""Porter's stemmer, from the published description of the algorithm, and Unicode normal form, in Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: suffix rules of steps 2, 3 and 4
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(stem: str) -> str:
    """The stem's letters as v and c."""
    out = ""
    for i, letter in enumerate(stem):
        vowel = letter in "aeiou" or letter == "y" and i > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def measure(stem: str) -> int:
    return len(re.findall("v+c+", shape(stem)))


def ends_cvc(stem: str) -> bool:
    return shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    elif (cut := longest(word, ("ed", "ing"))) and "v" in shape(word[: -len(cut)]):
        word = word[: -len(cut)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif measure(word) == 1 and ends_cvc(word):
            word += "e"
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP2, STEP3):
        if (cut := longest(word, rules)) and measure(word[: -len(cut)]) > 0:
            word = word[: -len(cut)] + rules[cut]
    if (cut := longest(word, STEP4)) and measure(word[: -len(cut)]) > 1 and (cut != "ion" or word[: -len(cut)].endswith(("s", "t"))):
        word = word[: -len(cut)]
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or m == 1 and not ends_cvc(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and measure(word) > 1:
        word = word[:-1]
    return word


def _stem_batch(tokens: pd.Series) -> pd.Series:
    seen: dict[str, str] = {}
    return pd.Series([[seen[w] if w in seen else seen.setdefault(w, stem(w)) for w in t] if t is not None else None for t in tokens])


def stems(tokens: Column) -> Column:
    """Stems of an array of lower-case words."""
    return F.pandas_udf(_stem_batch, "array<string>")(tokens)


def _nfkc_batch(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    return F.pandas_udf(_nfkc_batch, "string")(text)
