"""Query strings to query plans, on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions import analysis
from ..functions.words import word_list
from ..schema import NGRAMS

MAX_TERMS = 100


@dataclass
class Query:
    """kind: union, intersection or phrase. terms: distinct terms that must or may match. phrases: term sequences; excluded: terms that must not match."""

    kind: str
    terms: list[str] = field(default_factory=list)
    phrases: list[list[str]] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)

    @property
    def empty(self) -> bool:
        return not self.terms


_PY_TOKEN = re.compile(r"[^\W][\w+#-]*")


def split(text: str, tokenizer: str, dictionary=None) -> list[str]:
    """Tokens of a short string, as the column expressions give them."""
    if tokenizer == "AsciiAlphabetic":
        return re.findall("[a-z]+", text.translate(str.maketrans(analysis.UPPER, analysis.LOWER)))
    if tokenizer == "UnicodeAlphanumeric":
        return _PY_TOKEN.findall(text.lower())
    if tokenizer == "UnicodeAlphanumericFolded":
        return analysis.folded_tokens(text)
    if tokenizer == "UnicodeAlphanumericZH":
        return analysis.zh_tokens(text, dictionary or {})
    return (text.translate(str.maketrans(analysis.UPPER, analysis.LOWER)) if tokenizer == "WhitespaceLowercase" else text).split()


_PART = re.compile(r'([+-]?)"([^"]*)"?|(\S+)')


def parse(text: str, meta, default: str = "intersection", dictionary=None) -> Query:
    """``+`` before a term requires it (the whole query becomes an intersection), ``-`` excludes it, quotes make a phrase (the whole query becomes a phrase query, its other terms are required)."""
    stop = set(word_list(meta.stop_words))
    dictionary = dictionary or analysis.log_dictionary(meta.zh_dictionary)
    stem = (lambda t: t) if not meta.stemmer or meta.stemmer.lower() == "none" else _stemmer(meta.stemmer)
    clean = lambda s: [stem(t) for t in split(s, meta.tokenizer, dictionary) if t not in stop]
    q = Query(default)
    required: list[str] = []
    for m in _PART.finditer(text):
        sign, quoted, plain = m[1], m[2], m[3]
        if plain is None:
            words = clean(quoted)
            if sign == "-":
                q.excluded += words
            elif words:
                q.kind = "phrase"
                q.phrases.append(words)
                required += words
            continue
        if plain[0] == "-" and len(plain) > 1:
            q.excluded += clean(plain[1:])
        else:
            words = clean(plain.lstrip("+") if plain[0] == "+" else plain)
            if plain[0] == "+" and q.kind != "phrase":
                q.kind = "intersection"
            required += words
    q.terms = list(dict.fromkeys(required))[:MAX_TERMS]
    q.excluded = list(dict.fromkeys(q.excluded))
    if q.kind == "phrase" and not any(len(p) > 1 for p in q.phrases):
        q.kind = "intersection"
    if default == "phrase" and not q.phrases and len(required) > 1:
        q.kind, q.phrases = "phrase", [required]
    return q


def _stemmer(name: str):
    from ..functions.stemmers import stemmer

    return stemmer(name)


def ngram_kinds(mask: int) -> set[str]:
    return {k for k, bit in NGRAMS.items() if mask & bit}


def ngram_terms(words: list[str], frequent: set[str], mask: int) -> list[tuple[int, list[str]]]:
    """(position, words) of the n-grams that an index of these kinds holds for a token sequence; they overlap."""
    kinds, out = ngram_kinds(mask), []
    code = ["F" if w in frequent else "R" for w in words]
    for i in range(len(words)):
        for n in (2, 3):
            if i + n <= len(words) and "".join(code[i : i + n]) in kinds:
                out.append((i, words[i : i + n]))
    return out


def rewrite_phrase(words: list[str], frequent: set[str], mask: int) -> list[tuple[int, list[str]]]:
    """Greedy cover of a phrase, from the left and trigrams first, by indexed n-grams and single words: (position, words)."""
    kinds = ngram_kinds(mask)
    code = ["F" if w in frequent else "R" for w in words]
    out, i = [], 0
    while i < len(words):
        n = next((n for n in (3, 2) if i + n <= len(words) and "".join(code[i : i + n]) in kinds), 1)
        out.append((i, words[i : i + n]))
        i += n
    return out
