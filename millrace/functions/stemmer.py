"""Suffix stripping after Porter (1980), in the variant that the pipelines of this library expect.

Differences from the paper: input is lower-cased; `ed` and `ing` are tried before `eed`; in steps 2 to 4 the first rule whose suffix and
condition both hold is applied, so a longer suffix that fails leaves the word to a shorter one; the w, x, y exception of the
short-syllable test looks at the vowel's place; words of one or two letters are not spared.
"""

from __future__ import annotations


def _consonant(w: str, i: int) -> bool:
    if w[i] in "aeiou":
        return False
    return w[i] != "y" or i == 0 or not _consonant(w, i - 1)


def _measure(w: str) -> int:
    kinds = [_consonant(w, i) for i in range(len(w))]
    return sum(not a and b for a, b in zip(kinds, kinds[1:]))


def _vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _short(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-2] not in "wxy"


_SECOND = [x.split(">") for x in "ational>ate tional>tion enci>ence anci>ance izer>ize bli>ble abli>able alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble logi>log".split()]
_THIRD = [x.split(">") for x in "icate>ic ative> alize>al iciti>ic ical>ic ful> ness>".split()]
_FOURTH = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _rules(w: str, rules: list[list[str]], least: int) -> str:
    for suffix, to in rules:
        if w.endswith(suffix) and _measure(head := w[: len(w) - len(suffix)]) > least:
            return head + to
    return w


def _first(w: str) -> str:
    for suffix, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(suffix):
            w = w[: len(w) - len(suffix)] + to
            break
    cut = next((s for s in ("ed", "ing") if w.endswith(s) and _vowel(w[: -len(s)])), None)
    if cut:
        w = w[: -len(cut)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    elif w.endswith("eed") and _measure(w[:-3]) > 0:
        w = w[:-1]
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    return w


def stem(word: str) -> str:
    w = _rules(_rules(_first(word.lower()), _SECOND, 0), _THIRD, 0)
    for suffix in _FOURTH:
        if w.endswith(suffix):
            head = w[: len(w) - len(suffix)]
            if _measure(head) > 1 and (suffix != "ion" or head[-1:] in ("s", "t")):
                w = head
                break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w
