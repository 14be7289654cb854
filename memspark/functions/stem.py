"""Index terms folded and stemmed: accents stripped, then the suffix rules of Porter's published algorithm (1980)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# The algorithm's suffixes and what takes their place, by step.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
ENDINGS = tuple((step, tuple(step)) for step in (STEP_2, STEP_3))
LETTERS = str.maketrans({x: "v" if x in "aeiou" else "c" for x in "abcdefghijklmnopqrstuvwxyz"})
STEP_4 = tuple("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split())
#: By last letter, the endings that some rule looks for: a word without any of them is its own stem.
RULED = {x: tuple(e for e in ("s", "eed", "ed", "ing", "y", *STEP_2, *STEP_3, *STEP_4, "e", "ll") if e[-1] == x) for x in "abcdefghijklmnopqrstuvwxyz"}
WORD = re.compile("[a-z]+")


def _shape(word: str) -> str:
    """v for each vowel and c for each consonant; y is a vowel after a consonant."""
    if "y" not in word:
        return word.translate(LETTERS)
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """Runs of vowels with consonants after them."""
    return _shape(stem).count("vc")


def _short(word: str) -> bool:
    """Whether a word ends consonant, vowel, consonant, the last not being w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _longest(word: str, suffixes: tuple[str, ...]) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len) if word.endswith(suffixes) else None


def stem(word: str) -> str:
    """The stem of a lower-case word of a to z; other words stay as they are."""
    if len(word) < 3 or not WORD.fullmatch(word) or not word.endswith(RULED[word[-1]]):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    ending = _longest(word, ("eed", "ed", "ing"))
    if ending == "eed":
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif ending and "v" in _shape(word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for step, endings in ENDINGS:
        ending = _longest(word, endings)
        if ending and _measure(word[: -len(ending)]) > 0:
            word = word[: -len(ending)] + step[ending]
    ending = _longest(word, STEP_4)
    if ending and _measure(word[: -len(ending)]) > 1 and (ending != "ion" or word[: -len(ending)].endswith(("s", "t"))):
        word = word[: -len(ending)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def fold(word: str) -> str:
    """The word without accents."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


@pandas_udf(StringType())
def stemmed(x: pd.Series) -> pd.Series:
    """Folded and stemmed terms. Meant for distinct terms, not for each word of a corpus."""
    return x.map(lambda w: None if w is None else stem(fold(w)))
