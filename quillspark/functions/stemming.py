"""English word stems after the published description of the Snowball English ("Porter2") algorithm."""

from __future__ import annotations

import re

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

# Exceptional words and suffixes of the published algorithm.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_UNCHANGED = frozenset("sky news howe atlas cosmos bias andes".split())
_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_R1_PREFIXES = ("gener", "commun", "arsen")
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()
_LI_ENDINGS = "cdeghkmnrt"


def _region(word: str, start: int = 0) -> int:
    """Where the region after the first consonant that follows a vowel begins."""
    m = re.search(f"[{_VOWELS}][^{_VOWELS}]", word[start:])
    return start + m.end() if m else len(word)


def _short_ending(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-1] not in _VOWELS + "wxY" and word[-2] in _VOWELS and word[-3] not in _VOWELS


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plurals(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_VOWELS}]", w[:-2]):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    suffix = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if not suffix:
        return w
    base = w[: -len(suffix)]
    if suffix.startswith("eed"):
        return base + "ee" if len(base) >= r1 else w
    if not re.search(f"[{_VOWELS}]", base):
        return w
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base.endswith(_DOUBLES):
        return base[:-1]
    return base + "e" if r1 >= len(base) and _short_ending(base) else base


def _suffixes(w: str, r1: int, r2: int) -> str:
    if (s := _longest(w, (*_STEP2, "ogi", "li"))) and len(w) - len(s) >= r1:
        base = w[: -len(s)]
        if s in _STEP2:
            w = base + _STEP2[s]
        elif s == "ogi" and base.endswith("l"):
            w = base + "og"
        elif s == "li" and base.endswith(tuple(_LI_ENDINGS)):
            w = base
    if (s := _longest(w, (*_STEP3, "ative"))) and len(w) - len(s) >= r1:
        base = w[: -len(s)]
        if s in _STEP3:
            w = base + _STEP3[s]
        elif len(base) >= r2:
            w = base
    if (s := _longest(w, (*_STEP4, "ion"))) and len(w) - len(s) >= r2:
        base = w[: -len(s)]
        if s != "ion" or base.endswith(("s", "t")):
            w = base
    return w


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    w = word.removeprefix("'")
    if w in _SPECIAL:
        return _SPECIAL[w]
    if w in _UNCHANGED:
        return w
    w = re.sub(f"(^|(?<=[{_VOWELS}]))y", "Y", w)
    prefix = next((p for p in _R1_PREFIXES if w.startswith(p)), None)
    r1 = len(prefix) if prefix else _region(w)
    r2 = _region(w, r1)
    w = re.sub(r"'s'$|'s$|'$", "", w)
    w = _plurals(w)
    if w in _AFTER_1A:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    w = _suffixes(w, r1, r2)
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_ending(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
