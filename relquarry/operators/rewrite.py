"""Spelling correction and query completion from dictionaries."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import SpellingCorrection


def damerau_levenshtein(a: str, b: str) -> int:
    """Edits between two strings, where swapping two neighbours is one (unrestricted)."""
    last: dict[str, int] = {}
    big = len(a) + len(b)
    d = {(-1, -1): big}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = big, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = big, j
    for i in range(1, len(a) + 1):
        at = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), at
            cost = a[i - 1] != b[j - 1]
            at = at if cost else j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


@F.pandas_udf(T.IntegerType())
def _damerau(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([damerau_levenshtein(x, y) for x, y in zip(a, b)])


def near_terms(dictionary: DataFrame, words, distance: int = 1, count_threshold: int = 0) -> DataFrame:
    """word, term, distance, df of dictionary terms within a Damerau-Levenshtein distance of given words.

    Spark's levenshtein, where a swap costs two, narrows the terms down; few reach Python.
    """
    given = F.explode(F.array(*[F.lit(w) for w in words])).alias("word")
    rows = dictionary.where((F.col("df") >= count_threshold) & (F.length("term") > 0))
    rows = rows.where(F.length("term").between(min(map(len, words)) - distance, max(map(len, words)) + distance)).select("term", "df", given)
    rows = rows.where(F.abs(F.length("term") - F.length("word")) <= distance).where((F.levenshtein("term", "word", 2 * distance) >= 0))
    return rows.withColumn("distance", _damerau("word", "term")).where(F.col("distance") <= distance)


def allowed_distance(word: str, config: SpellingCorrection) -> int:
    """The base distance from the first length threshold on, and one edit more from each further one; none under the first."""
    if not config.term_length_threshold:
        return config.max_dictionary_edit_distance
    passed = sum(len(word) >= t for t in config.term_length_threshold)
    return config.max_dictionary_edit_distance + passed - 1 if passed else 0


@dataclass(frozen=True)
class _Choice:
    cost: int
    count: int
    words: tuple[str, ...]


def correct(dictionary: DataFrame, text_words: list[str], config: SpellingCorrection, frequent_enough: int | None = None) -> list[str]:
    """Words with replacements, splits in two, and merges of neighbours where the dictionary has better ones.

    One query over the dictionary fetches every candidate for all words; the choice among
    them is a shortest path over the words. Ties: fewer edits, then the higher count,
    then the alphabet.
    """
    if not text_words:
        return []
    least = config.count_threshold if frequent_enough is None else frequent_enough
    merged = [a + b for a, b in zip(text_words, text_words[1:])]
    pieces = {w[:i] for w in text_words for i in range(1, len(w))} | {w[i:] for w in text_words for i in range(1, len(w))}
    exact = {r["term"]: r["df"] for r in dictionary.where(F.col("term").isin([*text_words, *merged, *pieces]) & (F.col("df") >= least)).collect()}
    wanted = [w for w in {*text_words, *merged} if w not in exact and allowed_distance(w, config)]
    near: dict[str, list[tuple[int, int, str]]] = {}
    if wanted:
        for r in near_terms(dictionary, sorted(wanted), max(allowed_distance(w, config) for w in wanted), least).collect():
            if r["distance"] <= allowed_distance(r["word"], config):
                near.setdefault(r["word"], []).append((r["distance"], -r["df"], r["term"]))

    def options(word: str, extra: int) -> list[_Choice]:
        if word in exact:
            return [_Choice(extra, exact[word], (word,))]
        out = [_Choice(d + extra, -c, (t,)) for d, c, t in sorted(near.get(word, ()))[:1]]
        out += [_Choice(1 + extra, min(exact[word[:i]], exact[word[i:]]), (word[:i], word[i:])) for i in range(1, len(word)) if word[:i] in exact and word[i:] in exact]
        return out

    best: list[tuple[int, int, tuple[str, ...]]] = [(0, 0, ())]
    for i, w in enumerate(text_words):
        ways = [(best[i], c) for c in options(w, 0) or [_Choice(3, 0, (w,))]]
        if i and text_words[i - 1] not in exact or i and w not in exact:
            ways += [(best[i - 1], c) for c in options(text_words[i - 1] + w, 1)]
        best.append(min(((p[0] + c.cost, p[1] - c.count, p[2] + c.words) for p, c in ways), key=lambda x: x))
    return list(best[-1][2])


def complete(grams: DataFrame, words: list[str], typing: bool = True, length: int = 10) -> DataFrame:
    """completion, n: the most frequent completions of the last (up to three) words; earlier words stay in front."""
    tail = words[-3:]
    head = " ".join(words[:-3])
    prefix = " ".join(tail) + ("" if typing else " ")
    out = grams.where(F.col("gram").startswith(prefix)).orderBy(F.col("n").desc(), "gram").limit(length)
    return out.select((F.concat(F.lit(head + " "), "gram") if head else F.col("gram")).alias("completion"), "n")


def expand(grams: DataFrame, words: list[str], typing: bool = True, length: int = 10) -> list[tuple[str, int]]:
    """Completions; where there are too few, those of ever shorter tails, with the words before in front."""
    out: dict[str, int] = {}
    for k in (3, 2, 1):
        tail = words[-k:]
        if len(tail) < k and k > 1:
            continue
        head = " ".join(words[: len(words) - k])
        for r in complete(grams, tail, typing, length).collect():
            full = f"{head} {r['completion']}".strip()
            out.setdefault(full, r["n"])
        if len(out) >= length:
            break
    return list(out.items())[:length]


def suggest(grams: DataFrame, dictionary: DataFrame, words: list[str], config: SpellingCorrection | None, typing: bool = True, length: int = 10) -> list[tuple[str, int]]:
    """Completions; if there are none, those of the corrected words."""
    out = expand(grams, words, typing, length)
    if out or not config:
        return out
    better = correct(dictionary, words, config)
    return expand(grams, better, typing, length) if better != words else []
