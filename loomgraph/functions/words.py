"""Text search: tokens of a text, reduced to stems by Porter's algorithm."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    """Runs of letters and digits in lower case without diacritics."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _TOKEN.findall(plain.lower())


def _consonant(w: str, i: int) -> bool:
    return w[i] not in "aeiou" and (w[i] != "y" or i == 0 or not _consonant(w, i - 1))


def _measure(w: str) -> int:
    return len(re.findall("vc", re.sub(r"(.)\1*", r"\1", "".join("c" if _consonant(w, i) else "v" for i in range(len(w))))))


def _vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _short(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 1) and not _consonant(w, n - 2) and _consonant(w, n - 3) and w[-1] not in "wxy"


_STEP2 = "ational ate,tional tion,enci ence,anci ance,izer ize,abli able,alli al,entli ent,eli e,ousli ous,ization ize,ation ate,ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,biliti ble"
_STEP3 = "icate ic,ative ,alize al,iciti ic,ical ic,ful ,ness "
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
_PAIRS = [sorted((tuple(x.split(" ")) for x in s.split(",")), key=lambda p: -len(p[0])) for s in (_STEP2, _STEP3)]


@lru_cache(maxsize=50_000)
def stem(w: str) -> str:
    """The stem of a lower-case English word; others come back nearly unchanged."""
    if len(w) < 3 or not w.isascii():
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for pairs in _PAIRS:
        for end, to in pairs:
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + to
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
