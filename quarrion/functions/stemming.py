"""Stemmers as plain functions of a word."""

from __future__ import annotations

VOWELS = "aeiou"


def _consonant(word: str, i: int) -> bool:
    c = word[i]
    return c not in VOWELS and not (c == "y" and i > 0 and _consonant(word, i - 1))


def _measure(stem: str) -> int:
    """The number of vowel-consonant changes."""
    kinds = [_consonant(stem, i) for i in range(len(stem))]
    return sum(1 for a, b in zip(kinds, kinds[1:]) if not a and b)


def _has_vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y."""
    n = len(word)
    return n >= 3 and _consonant(word, n - 1) and not _consonant(word, n - 2) and _consonant(word, n - 3) and word[-1] not in "wxy"


# The suffixes of the published algorithm's steps 2, 3 and 4.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def porter(word: str) -> str:
    """The stem by Porter's algorithm."""
    w = word
    if len(w) < 3 or not w.isascii():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        found = max((p for p in table if w.endswith(p[0])), key=lambda p: len(p[0]), default=None)
        if found and _measure(w[: -len(found[0])]):
            w = w[: -len(found[0])] + found[1]
    found = max((s for s in STEP4 if w.endswith(s)), key=len, default=None)
    if found:
        stem = w[: -len(found)]
        if _measure(stem) > 1 and (found != "ion" or stem.endswith(("s", "t"))):
            w = stem
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def english_minimal(word: str) -> str:
    """Plurals to singulars by three endings."""
    if len(word) < 3 or word[-1] != "s" or word.endswith(("us", "ss")):
        return word
    if word.endswith("ies") and len(word) > 3 and word[-4] not in "ae":
        return word[:-3] + "y"
    if word.endswith("es") and word[-3] in "iaoe":
        return word
    return word[:-1]


def spanish_plural(word: str) -> str:
    if len(word) < 4 or word[-1] != "s":
        return word
    if word.endswith("ces"):
        return word[:-3] + "z"
    if word.endswith("es") and word[-3] not in "aeiou":
        return word[:-2]
    return word[:-1]
