"""Stemmers. English follows Porter's published algorithm; German, French, Spanish and others strip endings in the region after the first vowel-consonant pair."""

from __future__ import annotations

import re
from collections.abc import Callable

_V = "aeiou"


def _measure(stem: str) -> int:
    """Number of vowel-consonant turns."""
    kinds = "".join("v" if c in _V or (c == "y" and i and stem[i - 1] not in _V) else "c" for i, c in enumerate(stem))
    return len(re.findall("v+c+", kinds))


def _has_vowel(stem: str) -> bool:
    return any(c in _V or (c == "y" and i > 0) for i, c in enumerate(stem))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and w[-1] not in _V


def _cvc(w: str) -> bool:
    if len(w) < 3 or w[-1] in "wxy":
        return False
    is_v = lambda i: w[i] in _V or (w[i] == "y" and i > 0 and w[i - 1] not in _V)
    n = len(w)
    return not is_v(n - 1) and is_v(n - 2) and not is_v(n - 3)


_STEP2 = [tuple(x.split(":")) for x in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split()]
_STEP3 = [tuple(x.split(":")) for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split()]
_STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic ou".split()


def english(word: str) -> str:
    w = word
    if len(w) < 3 or not w.isascii():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((w[: -len(e)] for e in ("ed", "ing") if w.endswith(e) and _has_vowel(w[: -len(e)])), None)
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, new in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in _STEP4:
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


#: Endings, longest first, of light stemmers; "x:y" replaces x by y.
ENDINGS = {
    "german": "erinnen ern em er en es e s st",
    "french": "issements issement ations atrices ateurs ation ements ement euses euse eux ives ive ables able istes iste ités ité ments ment ées ée és er ez es e s é",
    "spanish": "amientos imientos amiento imiento aciones ación adores adoras mente idades idad ables ibles ando iendo ados idos adas idas ado ido ada ida ar er ir os as es o a e s",
    "italian": "amenti imenti amento imento azioni azione mente abili ando endo ato ata ati ate are ere ire i e o a",
    "portuguese": "amentos imentos amento imento ações ação mente idades idade ando endo ados idos ado ido ada ida ar er ir os as es o a e",
    "dutch": "heden heid ingen ing en e s",
    "swedish": "heterna heten arna erna orna heter ande are ade het ens arn ern or ar er en at a e s",
    "norwegian": "hetene heten ende ene ane ede het ers ets er et en ar a e s",
    "danish": "erendes erende hedens ethed erede heden erne ernes ende eren erer es er et en e s",
    "finnish": "issa issä ista istä iden ssa ssä sta stä lla llä lta ltä lle ksi in en an t n a ä",
    "russian": "иями ями ами иях ях ах ией ей ой ий ый ая яя ое ее ые ие ого его ому ему ешь ет ут ют ит ат ят ть ла ли ло ов ев ом ем ам ям у ю а я о е ы и й ь",
}


def _light(endings: str) -> Callable[[str], str]:
    ends = sorted(endings.split(), key=lambda e: (-len(e), e))

    def stem(word: str) -> str:
        m = re.match(r".*?[aeiouyàâäáãåæèéêëìíîïòóôöõøùúûüœаеёиоуыэюя][^aeiouyàâäáãåæèéêëìíîïòóôöõøùúûüœаеёиоуыэюя]", word)
        least = max(3, m.end() if m else len(word))
        for e in ends:
            if word.endswith(e) and len(word) - len(e) >= least:
                return word[: -len(e)]
        return word

    return stem


STEMMERS: dict[str, Callable[[str], str]] = {"english": english, "porter": english} | {k: _light(v) for k, v in ENDINGS.items()}


def stemmer(name: str) -> Callable[[str], str]:
    try:
        return STEMMERS[name.lower()]
    except KeyError:
        raise ValueError(f"no stemmer for {name}; there are {', '.join(sorted(STEMMERS))}") from None
