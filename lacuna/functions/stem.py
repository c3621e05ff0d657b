"""Stems of English words by the published suffix-stripping algorithm (Porter, 1980), with the usual later amendments."""

from __future__ import annotations

from functools import lru_cache

_VOWELS = "aeiou"
#: Words whose stem the rules get wrong.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning",
    "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
#: Double suffixes and what they become behind a stem of measure 1 or more.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
#: Further suffixes, behind a stem of measure 1 or more.
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
#: Suffixes dropped behind a stem of measure 2 or more.
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _form(w: str) -> str:
    """``w`` as consonants (c) and vowels (v); y is a vowel behind a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in _VOWELS or (ch == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def measure(w: str) -> int:
    """Times a run of vowels is followed by a consonant."""
    return _form(w).count("vc")


def _short_end(w: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x and y; or is a vowel and a consonant."""
    f = _form(w)
    return (f.endswith("cvc") and w[-1] not in "wxy") or (len(w) == 2 and f == "vc")


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    for end in ("ed", "ing"):
        stem = w[: -len(end)]
        if w.endswith(end):
            if "v" not in _form(stem):
                return w
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and _form(stem)[-1] == "c":
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if measure(stem) == 1 and _short_end(stem) else stem
    return w


def _first_suffix(w: str, rules: tuple[tuple[str, str], ...]) -> str:
    """The longest suffix that fits is replaced if the stem before it has a measure of 1 or more."""
    for end, new in sorted(rules, key=lambda r: -len(r[0])):
        if w.endswith(end):
            stem = w[: -len(end)]
            return stem + new if measure(stem) > 0 else w
    return w


@lru_cache(maxsize=200_000)
def porter_stem(word: str) -> str:
    """Stem of a lower-case word; words of one or two letters stay."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and len(w) > 2 and _form(w)[-2] == "c":
        w = w[:-1] + "i"
    if w.endswith("alli") and measure(w[:-4]) > 0:
        w = w[:-2]
    if w.endswith("logi"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        w = _first_suffix(w, STEP_2)
    w = _first_suffix(w, STEP_3)
    for end in sorted(STEP_4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w
