"""English stems by the published Porter2 rules, for terms made before indexing."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Words left out before stemming.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "were", "will", "with")

# The tables of the Porter2 definition.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
VOWELS = "aeiouy"
DOUBLE = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
SHORT_END = re.compile(rf"([^{VOWELS}][{VOWELS}][^{VOWELS}wxY]|^[{VOWELS}][^{VOWELS}])$")
REGION = re.compile(rf"[{VOWELS}][^{VOWELS}]")


def _suffix(word: str, table) -> str | None:
    """The longest entry that ends ``word``."""
    return max((s for s in table if word.endswith(s)), key=len, default=None)


def _regions(word: str) -> tuple[int, int]:
    head = re.match("gener|commun|arsen", word)
    first = REGION.search(word)
    r1 = head.end() if head else first.end() if first else len(word)
    second = REGION.search(word, r1)
    return r1, second.end() if second else len(word)


@lru_cache(100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) < 3:
        return word
    w = re.sub(rf"(^|[{VOWELS}])y", r"\1Y", word)
    r1, r2 = _regions(w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(rf"[{VOWELS}].+s$", w):
        w = w[:-1]
    if w in KEPT:
        return w
    end = _suffix(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        w = w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    elif end and re.search(f"[{VOWELS}]", w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif DOUBLE.search(w):
            w = w[:-1]
        elif len(w) <= r1 and SHORT_END.search(w):
            w += "e"
    w = re.sub(rf"(?<=.)([^{VOWELS}])[yY]$", r"\1i", w)
    end = _suffix(w, STEP_2)
    if end and len(w) - len(end) >= r1:
        before = w[: -len(end)]
        if not (end == "ogi" and not before.endswith("l")) and not (end == "li" and before[-1:] not in tuple("cdeghkmnrt")):
            w = before + STEP_2[end]
    end = _suffix(w, STEP_3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + STEP_3[end]
    end = _suffix(w, STEP_4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    at = len(w) - 1
    if w.endswith("e") and (at >= r2 or (at >= r1 and not SHORT_END.search(w[:-1]))) or (w.endswith("ll") and at >= r2):
        w = w[:-1]
    return w.lower()


@F.pandas_udf(ArrayType(StringType()))
def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: [stem(w) for w in ws])


def _split(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda x: x != "")


def _stemmed(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return _stems(F.filter(words, lambda x: ~x.isin(*STOP_WORDS)))


#: Tokenizers by name: white space, or stems of the words that are no stop words.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {"split": _split, "snowball": _stemmed}
