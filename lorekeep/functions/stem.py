"""English words without their endings, by Porter's rules of 1980 with his two later changes (bli, logi).

A word is read as consonants C and vowels V; its measure is the number of times that a vowel is followed by a consonant.
Words of one or two letters, and those that hold anything but a to z, stay as they are.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: The endings of steps two to four, longest first where one ends another.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_WORD = re.compile(r"[a-z]{3,}\Z")


def _shape(text: str) -> str:
    """The text as C and V; a y is a vowel after a consonant."""
    shape = ""
    for c in text:
        shape += "V" if c in "aeiou" or (c == "y" and shape[-1:] == "C") else "C"
    return shape


def _measure(text: str) -> int:
    return len(re.findall("V+C", _shape(text)))


def _doubled(text: str) -> bool:
    return len(text) > 1 and text[-1] == text[-2] and _shape(text)[-1] == "C"


def _short(text: str) -> bool:
    """Whether it ends consonant, vowel, consonant, and not in w, x or y."""
    return _shape(text)[-3:] == "CVC" and text[-1] not in "wxy"


def _plural(word: str) -> str:
    for ending, put in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(ending):
            return word.removesuffix(ending) + put
    return word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for ending in ("ed", "ing"):
        if word.endswith(ending):
            rest = word.removesuffix(ending)
            if "V" not in _shape(rest):
                return word
            if rest.endswith(("at", "bl", "iz")):
                return rest + "e"
            if _doubled(rest) and rest[-1] not in "lsz":
                return rest[:-1]
            return rest + "e" if _measure(rest) == 1 and _short(rest) else rest
    return word


def _replaced(word: str, endings: tuple[tuple[str, str], ...]) -> str:
    """The longest ending that fits is replaced, if a measure is left before it."""
    found = max((e for e in endings if word.endswith(e[0])), key=lambda e: len(e[0]), default=None)
    if found and _measure(rest := word.removesuffix(found[0])) > 0:
        return rest + found[1]
    return word


def _dropped(word: str) -> str:
    found = max((e for e in STEP_4 if word.endswith(e)), key=len, default=None)
    if not found:
        return word
    rest = word.removesuffix(found)
    return rest if _measure(rest) > 1 and (found != "ion" or rest.endswith(("s", "t"))) else word


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if not _WORD.match(word):
        return word
    word = _past(_plural(word))
    if word.endswith("y") and "V" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _dropped(_replaced(_replaced(word, STEP_2), STEP_3))
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _short(rest)):
            word = rest
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word
