"""Boolean and phrase matching, and BM25F scores, over postings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.query import Query

K, B = 1.2, 0.75


def idf(n: int, df: int) -> float:
    return math.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25(tf: Column, dl: Column, avgdl: float) -> Column:
    """A term's weight in a field, without idf and boost."""
    return tf * (K + 1) / (tf + K * (1 - B + B * dl / F.lit(float(avgdl))))


def _lookup(keys, values, column: Column, other: float = 0.0) -> Column:
    out = F.lit(float(other))
    for k, v in zip(keys, values):
        out = F.when(column == F.lit(k), F.lit(float(v))).otherwise(out)
    return out


def _shifted(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda x: x - by)


def phrase_in(positions: list[Column]) -> Column:
    """Whether one position list starts a run through all of them."""
    run = positions[0]
    for i, p in enumerate(positions[1:], 1):
        run = F.array_intersect(run, _shifted(p, i))
    return F.coalesce(F.size(run) > 0, F.lit(False))


def phrase_docs(rows: DataFrame, words: list[str], fields: list[int] | None = None) -> DataFrame:
    """doc_id of documents with the words in a row in one field; a word may occur in it more than once."""
    rows = rows.where(F.col("term").isin(list(dict.fromkeys(words))))
    if fields is not None:
        rows = rows.where(F.col("field_id").isin(fields))
    names = list(dict.fromkeys(words))
    per = rows.groupBy("doc_id", "field_id").agg(*[F.first(F.when(F.col("term") == w, F.col("positions")), ignorenulls=True).alias(f"p{i}") for i, w in enumerate(names)])
    return per.where(phrase_in([F.col(f"p{names.index(w)}") for w in words])).select("doc_id").distinct()


def match(rows: DataFrame, query: Query, df: dict[str, int], n: int, avgdl: float, boosts: list[float], fields: list[int] | None = None, score: bool = True, weight_terms: dict[str, float] | None = None) -> DataFrame:
    """doc_id (and score) of the documents that a query matches.

    rows: postings. df, n, avgdl: statistics. fields: where a match may be; scores sum over
    all fields regardless. One shuffle on doc_id serves match, exclusion, phrases and score.
    """
    positive, negative = query.terms, query.excluded
    every = [*positive, *negative]
    phrases = query.phrases if query.kind == "phrase" else []
    wanted = rows.where(F.col("term").isin(every))
    allowed = F.lit(True) if fields is None else F.col("field_id").isin(fields)
    bit = lambda t: 1 << every.index(t)
    mask = F.lit(0).cast("decimal(38,0)") if len(every) > 62 else F.lit(0).cast("bigint")
    if len(every) > 62:  # more terms than bits: a set of terms
        seen = F.collect_set(F.when(allowed | F.col("term").isin(negative), F.col("term"))).alias("seen")
        hit = F.size(F.array_intersect("seen", F.array(*map(F.lit, positive))))
        cond = hit == len(positive) if query.kind != "union" else hit > 0
        if negative:
            cond &= ~F.arrays_overlap("seen", F.array(*map(F.lit, negative)))
    else:
        for t in every:
            mask = F.when(F.col("term") == t, F.lit(bit(t)).cast("bigint")).otherwise(mask)
        seen = F.bit_or(F.when(allowed | F.col("term").isin(negative), mask).otherwise(F.lit(0).cast("bigint"))).alias("seen")
        pos, neg = sum(map(bit, positive)), sum(bit(t) for t in negative if t not in positive)
        hit = F.col("seen").bitwiseAND(F.lit(pos).cast("bigint"))
        cond = (hit == pos) if query.kind != "union" else (hit != 0)
        if any(t in positive for t in negative):
            cond = F.lit(False)
        if neg:
            cond &= F.col("seen").bitwiseAND(F.lit(neg).cast("bigint")) == 0
    aggregates = [seen]
    if score:
        weight = weight_terms or {t: idf(n, df.get(t, 0)) for t in positive}
        w = _lookup(weight.keys(), weight.values(), F.col("term"))
        if len(boosts) > 1:
            w = w * _lookup(range(len(boosts)), boosts, F.col("field_id"), 1.0)
        aggregates.append(F.sum(w * bm25(F.col("tf"), F.col("dl"), avgdl or 1.0)).alias("score"))
    out = wanted.groupBy("doc_id").agg(*aggregates).where(cond).drop("seen")
    for words in phrases:
        if len(words) > 1:
            out = out.join(phrase_docs(rows, words, fields), "doc_id", "left_semi")
    return out


def rank(matches: DataFrame, length: int, offset: int = 0) -> DataFrame:
    """The best by score, rounded to 6 places; ties by doc_id."""
    out = matches.withColumn("score", F.round("score", 6)).orderBy(F.col("score").desc(), "doc_id")
    return (out.offset(offset) if offset else out).limit(length)


def statistics(tokens_len: DataFrame, docs: int | None = None) -> tuple[int, float]:
    """Number of documents, and the mean over documents of the lengths of all fields."""
    total, n = tokens_len.agg(F.sum("dl"), F.count_distinct("doc_id")).first()
    n = docs if docs is not None else n
    return n, (total or 0) / n if n else 0.0
