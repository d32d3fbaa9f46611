"""Keyword-in-context fragments with highlighted matches."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F

_SENTENCE = re.compile("[^!?.¿¡。、！？︒]*[!?.¿¡。、！？︒]?")


@dataclass(frozen=True)
class Highlight:
    field: str
    name: str = ""
    fragment_number: int = 0
    fragment_size: int = 0
    highlight_markup: bool = False
    pre_tags: str = "<b>"
    post_tags: str = "</b>"


def matcher(terms, synonyms=None) -> re.Pattern | None:
    """Leftmost-longest, case-insensitive matcher of terms and their synonyms, also inside words."""
    words = {t.lower() for t in terms if t}
    for t in list(words):
        words.update(s.lower() for s in (synonyms or {}).get(t, ()))
    return re.compile("|".join(map(re.escape, sorted(words, key=lambda w: (-len(w), w)))), re.I) if words else None


def fragment_score(text: str, pattern: re.Pattern) -> float:
    """New terms count 1, repeats 0.3, and terms that follow each other directly five times the length of their run."""
    seen: set[str] = set()
    score, run, end = 0.0, 1, None
    for m in pattern.finditer(text):
        word = m[0].lower()
        near = end is not None and m.start() - end <= 1
        run = run + 1 if near else 1
        score += 5.0 * run if near else 0.3 if word in seen else 1.0
        seen.add(word)
        end = m.end()
    return score


def trim(text: str, size: int, pattern: re.Pattern) -> str:
    """At most ``size`` characters, cut at spaces, around the first match."""
    if size <= 0 or len(text) <= size:
        return text
    m = pattern.search(text)
    start = 0
    if m and m.end() > size:
        start = max(0, min(m.start() - size // 2, len(text) - size))
        space = text.find(" ", start, m.start())
        start = space + 1 if space >= 0 else start
    end = min(len(text), start + size)
    if end < len(text):
        space = text.rfind(" ", max(start + 1, m.end() if m and m.end() <= end else start + 1), end)
        end = space if space > start else end
    return text[start:end]


def snippet(text: str | None, pattern: re.Pattern | None, h: Highlight) -> str | None:
    if text is None:
        return None
    if h.fragment_number:
        parts = [s.strip() for s in _SENTENCE.findall(text) if s.strip()] if h.fragment_size else [text]
        if pattern:
            scored = [(fragment_score(p, pattern), i, p) for i, p in enumerate(parts)]
            best = sorted(sorted((x for x in scored if x[0] > 0), key=lambda x: (-x[0], x[1]))[: h.fragment_number], key=lambda x: x[1])
            text = "...".join(trim(p, h.fragment_size, pattern) for _, _, p in best)
        else:
            text = "...".join(p[: h.fragment_size or None] for p in parts[: h.fragment_number])
    if h.highlight_markup and pattern:
        text = pattern.sub(lambda m: f"{h.pre_tags}{m[0]}{h.post_tags}", text)
    return text


def highlighter(terms, h: Highlight, synonyms=None):
    """Arrow UDF from a text column to its highlighted fragments."""
    terms = tuple(terms)

    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        pattern = matcher(terms, synonyms)
        return s.map(lambda t: snippet(t, pattern, h), na_action="ignore")

    return apply
