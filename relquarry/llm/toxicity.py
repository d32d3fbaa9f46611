"""Toxicity of documents, with obfuscated words restored through a noisy channel.

1. A character trigram model is counted over every document.
2. Segments that look obfuscated (look-alike digits and symbols inside words, letters or
   look-alikes spelled with any white space or punctuation between, words parted by
   punctuation, repeated letters) become lattices: each sign may stand for several
   letters, a repeated letter or a separator may be dropped. An exact Viterbi search over
   the whole segment, without a beam, picks the restored string that is likeliest under
   model and channel.
3. Indicators are words and word beginnings whose share of toxic documents, among labelled
   documents that have them, is high beyond chance. Near copies count once: of the
   documents with an indicator, the distinct smallest hashes of word triples are counted.
4. A text's score is the noisy-or of its indicators' shares, over its own words and the
   restored ones, and of a small base share.

Labels are learned from rows that aren't held out (crc32 of doc_id as text, mod 5, is not
0), at most MAX_LABELS of them, chosen by a hash of doc_id. No other column than text is
an input of a score.

Defined results. Null or empty text: the base share. Null doc_id: scored, not held out,
never learned from. Repeated rows: each scored; a doc_id with several labels is toxic if
one says so, and a null label says nothing. No labels, or none toxic: all get the base
share. Very long texts: whole. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from functools import partial
from math import ceil, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, prepare, slices, spread

MAX_LABELS, BASE, LEAST, PREFIXES, CACHE = 30_000, 0.02, 0.7, (4, 5, 6), 200_000
_words = re.compile(r"[^\W\d_]+").findall
_L = "a-zß-ÿ"
#: Signs that may stand for letters, and runs of white space and other punctuation.
_S, _GAP = r"[^\W_]|[@$!|+]", r"(?:[^\w@$!|+]|_)+"
_ODD = re.compile(
    rf"(?<!\w)(?:{_S})(?:{_GAP}(?:{_S})){{2,}}(?!\w)"  # s.p.e.l.l.e.d
    rf"|(?<![\w@$!|+])[{_L}0-9@$!|+]+(?:{_GAP}[{_L}0-9@$!|+]+)+"  # par-ted
    rf"|(?<![\w@$!|+])[0-9@$!|+]{{0,3}}[{_L}]+(?:[0-9@$!|+]{{1,6}}[{_L}]+)+(?:[013457@$](?!\w))?"  # w1th d1gits
    rf"|(?<![\w@$!|+])[013457@$!|+][{_L}]{{2,}}"
    rf"|\w*([{_L}])\1\w*"  # looong, ddoouubbllee
)
_SPELLED = re.compile(rf"(?<!\w)(?:{_S})(?:{_GAP}(?:{_S})){{2,}}(?!\w)")
_single = re.compile(r"(.)\1+", re.S).sub
_double = re.compile(rf"([{_L}])\1").search
_gaps, _gap, _spaced = re.compile(_GAP).sub, re.compile(_GAP).search, re.compile(r"\s").search
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "2": "z", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
SIGNS = 64
_COUNT = pa.schema([("gram", pa.int32()), ("n", pa.int64())])
_FEATURE = pa.schema([("feature", pa.string()), ("pos", pa.int64()), ("neg", pa.int64()), ("origins", pa.int64())])
_SCORE = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
_CODE = np.zeros(256, np.uint8)
_CODE[97:123] = np.arange(1, 27)
_CODE[0xDF:0x100] = np.arange(27, 60)


def sign(c: str) -> int:
    return int(_CODE[ord(c)]) if ord(c) < 256 else 0


def _grams(batches):
    total = np.zeros(SIGNS**3, np.int64)
    for b in slices(batches):
        text = " ".join(t.lower() for t in b.column("text").to_pylist() if t)
        codes = _CODE[np.frombuffer(f" {text} ".encode("latin-1", "replace"), np.uint8)].astype(np.int32)
        if len(codes) > 2:
            total += np.bincount((codes[:-2] * SIGNS + codes[1:-1]) * SIGNS + codes[2:], minlength=SIGNS**3)
    at = np.flatnonzero(total)
    yield batch(_COUNT, at.astype(np.int32), total[at])


class _Rows(dict):
    def __init__(self, log: np.ndarray):
        self.flat = log.reshape(-1, log.shape[2])

    def __missing__(self, pair: int) -> list[float]:
        self[pair] = row = self.flat[pair].tolist()
        return row


class CharModel:
    """Log probabilities of a sign after two, smoothed by shorter contexts."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(SIGNS, SIGNS, SIGNS).astype(float)
        one = c.sum(axis=(0, 1)) + 0.1
        one /= one.sum()
        two = c.sum(axis=0)
        two = (two + 20 * one) / (two.sum(axis=1, keepdims=True) + 20)
        self.log = np.log((c + 20 * two[None]) / (c.sum(axis=2, keepdims=True) + 20)).astype(np.float32)
        #: By the two signs before, as lists, which are faster to look single values up in.
        self.rows = _Rows(self.log)


def decode(segment: str, model: CharModel) -> str:
    """The likeliest letters behind a segment: an exact Viterbi search over its whole lattice; ties: the smaller string.

    A state is what later costs depend on: the last two signs, the last letter, and
    whether a repeat was dropped last. Strings are chains of (before, letter).
    """
    rows = model.rows
    states: dict[tuple, tuple[float, tuple | None]] = {(0, 0, "", False): (0.0, None)}
    for c in segment:
        options = [(x, -0.7, sign(x)) for x in LOOKS[c]] if c in LOOKS else [(c, 0.0, sign(c))] if c.isalpha() else []
        droppable = c in LOOKS
        after: dict[tuple, tuple[float, tuple | None]] = {}
        get = after.get

        def offer(key, p, s):
            old = get(key)
            if old is None or p > old[0] or (p == old[0] and _string(s) < _string(old[1])):
                after[key] = (p, s)

        for key, (p, s) in states.items():
            a, b, last, dropped = key
            row = rows[a * SIGNS + b]
            if not options:
                offer((a, b, last, dropped), p, s)
                offer((b, 0, "", False), p - 1.0 + row[0], (s, " "))
            for letter, cost, k in options:
                offer((b, k, letter, False), p + cost + row[k], (s, letter))
                if letter == last:
                    offer((a, b, last, True), p + cost - (0.2 if dropped else 2.5), s)
            if droppable:
                offer(key, p - 12.0, s)
        states = after
    ends = [(p + rows[a * SIGNS + b][0], s) for (a, b, _, _), (p, s) in states.items()]
    best = max(p for p, _ in ends)
    return min(_string(s) for p, s in ends if p == best)


def _string(chain: tuple | None) -> str:
    out = []
    while chain is not None:
        chain, letter = chain
        out.append(letter)
    return "".join(reversed(out))


class Restorer:
    """Lower-cased words of a text's tokens (by white space), with the restored ones."""

    def __init__(self, model: CharModel):
        self.model = model

    def tokens(self, text: str | None) -> set[str]:
        """Distinct tokens, and runs of single letters, which are restored as one."""
        low = (text or "").lower()
        found = set(low.split())
        found.update(m[0] for m in _SPELLED.finditer(low) if _spaced(m[0]))
        return found

    def words(self, token: str, may=None):
        """Words of one token, as they stand and restored. may: whether a plain word's restored form can matter."""
        plain = token.strip(".,;:?()\"'")
        if plain.isalpha():  # most are: a word between punctuation, of which only doubled letters can be odd
            yield plain
            if _double(plain) and (may is None or may(plain)):
                yield from decode(plain, self.model).split()
            return
        yield from _words(token)
        for m in _ODD.finditer(token):
            # one sign a gap; signs at the end are punctuation
            s = _gaps(" ", m[0]).rstrip("!|+") if _gap(m[0]) else m[0]
            yield from decode(s, self.model).split()


def features(word: str):
    yield "=" + word
    for k in PREFIXES:
        if len(word) >= k:
            yield "^" + word[:k]


def _origin(text: str) -> int:
    """The same for most near copies, and spread over unrelated texts: from the smallest hash of three words in a row; 0 to 63."""
    w = text.lower().split()
    least = min(map(zlib.crc32, map(str.encode, map(" ".join, zip(w, w[1:], w[2:])) if len(w) > 2 else [" ".join(w)])))
    return zlib.crc32(least.to_bytes(4, "little")) & 63


def _learn(batches, counts: np.ndarray):
    restorer = Restorer(CharModel(counts))
    made: dict[str, tuple[str, ...]] = {}
    found: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])

    def out():
        rows = [(f, p, n, m - (1 << 64) if m >> 63 else m) for f, (p, n, m) in found.items()]
        found.clear()
        return batch(_FEATURE, *zip(*rows)) if rows else None

    for b in slices(batches):
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            words = restorer.tokens(text)
            own: set[str] = set()
            for w in words:
                f = made.get(w)
                if f is None:
                    if len(made) > CACHE:
                        made.clear()
                    f = made[w] = tuple({f for x in restorer.words(w) for f in features(x)})
                own.update(f)
            mask = 1 << _origin(text or "") if toxic else 0
            for f in own:
                x = found[f]
                if toxic:
                    x[0] += 1
                    x[2] |= mask
                else:
                    x[1] += 1
        if len(found) > CACHE and (r := out()):
            yield r
    if r := out():
        yield r


def _log_tail(k: int, n: int, p: float) -> float:
    """Log of an upper bound of P(X >= k) for n draws of chance p, k over n * p (its first term, times a geometric sum)."""
    ratio = (n - k) / (k + 1) * p / (1 - p)
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p) - log(max(1e-9, 1 - min(ratio, 0.999)))


def indicators(rows, n_pos: int, n_neg: int, tested: int) -> dict[str, float]:
    """Share of toxic documents by feature, of (feature, pos, neg, origins) rows that chance doesn't explain."""
    if not n_pos or not n_neg:
        return {}
    prior, out, count, dropped = n_pos / (n_pos + n_neg), {}, {}, set()
    bound = log(0.01 / max(tested, 1))
    for f, pos, neg, origins in rows:
        bits = (origins & ((1 << 64) - 1)).bit_count()
        # origins hash to 64 places; so many distinct ones fill that many of them on average
        distinct = pos if bits > 40 else min(pos, round(log(1 - bits / 64) / log(1 - 1 / 64)))
        if distinct >= 3 and distinct > prior * (distinct + neg) and _log_tail(distinct, distinct + neg, prior) < bound:
            share = (distinct + prior) / (distinct + neg + 1)
            if share > LEAST:
                out[f] = share
                count[f] = pos, neg
    # a beginning that owes its share to one longer beginning or word, and is clean without it, is none
    for f in [f for f in out if f[0] == "^"]:
        best = max((g for g in out if len(g) > len(f) - (g[0] == "=") and g[1:].startswith(f[1:]) and g != f and out[g] > out[f]), key=lambda g: (count[g][0], g), default=None)
        if best and count[f][0] - count[best][0] <= count[f][1] - count[best][1]:
            dropped.add(f)
    out = {f: s for f, s in out.items() if f not in dropped}
    # a longer beginning or the word itself adds nothing to a beginning that is as sure
    return {f: s for f, s in out.items() if not any(out.get("^" + f[1 : k + 1], 0) >= s for k in PREFIXES if k < len(f) - (f[0] == "^"))}


class Scorer:
    def __init__(self, model: CharModel, weights: dict[str, float]):
        self.restorer, self.weights, self.of, self.before = Restorer(model), weights, {}, {}
        # a word restored from doubled letters is the same as it without any repeat, and so are their beginnings
        self.single = {_single(r"\1", f[1:]) for f in weights}
        self.lengths = sorted({len(f) for f in self.single})

    def _may(self, word: str) -> bool:
        """Whether a word may have an indicator once letters that repeat are dropped."""
        s = _single(r"\1", word)
        return any(s[:k] in self.single for k in self.lengths)

    def score(self, text: str | None) -> float:
        if len(self.of) > CACHE:  # frequent tokens come back from the cache before
            self.of, self.before = {}, self.of
        of, before, weights, left = self.of, self.before, self.weights, 1 - BASE
        found = set()
        for w in self.restorer.tokens(text):
            f = of.get(w)
            if f is None and (f := before.get(w)) is not None:
                of[w] = f
            elif f is None:
                hits = ([x for x in features(v) if x in weights] for v in self.restorer.words(w, self._may))
                f = of[w] = tuple({max(h, key=lambda x: (weights[x], x)) for h in hits if h})
            if f:
                found.update(f)
        for f in sorted(found):
            left *= 1 - weights[f]
        return 1 - left


def _score(batches, counts: np.ndarray, weights: dict[str, float]):
    scorer = Scorer(CharModel(counts), weights)
    for b in slices(batches):
        yield batch(_SCORE, b.column("doc_id"), [scorer.score(t) for t in b.column("text").to_pylist()])


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def char_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all documents; at most SIGNS**3 rows reach the driver."""
    rows = docs.select("text").mapInArrow(_grams, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SIGNS**3, np.int64)
    counts[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return counts


def learn(docs: DataFrame, labels: DataFrame, counts: np.ndarray, max_labels: int = MAX_LABELS) -> dict[str, float]:
    """Indicators and their shares, from labelled rows that aren't held out."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out())
    total = known.count()
    share = min(1.0, max_labels / max(1, total))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < ceil(share * (1 << 20))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # at most about max_labels rows of 12 bytes
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("text", "toxic")
    found = rows.mapInArrow(partial(_learn, counts=counts), "feature string, pos bigint, neg bigint, origins bigint")
    found = found.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.bit_or("origins").alias("origins"))
    n_pos, n_neg = known.agg(F.sum(F.col("toxic").cast("int")), F.sum(1 - F.col("toxic"))).first()
    # a feature can only matter if most of its documents are toxic; each such has at least 3, so their number is bounded by the sample's words
    good = found.where("pos >= 3 and pos > neg").collect()
    return indicators(sorted(map(tuple, good)), n_pos or 0, n_neg or 0, 1_000_000)


def score_toxicity(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if the score is 0.5 or more) of every document."""
    prepare(docs.sparkSession)
    docs = spread(docs)
    counts = char_counts(docs)
    weights = learn(docs, labels, counts, max_labels)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(partial(_score, counts=counts, weights=weights), "doc_id bigint, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """The documents, with all their columns, whose score is under 0.5."""
    prepare(docs.sparkSession)
    docs = spread(docs)
    counts = char_counts(docs)
    weights = learn(docs, labels, counts, max_labels)

    def kept(batches):
        scorer = Scorer(CharModel(counts), weights)
        for b in slices(batches):
            ok = pa.array([scorer.score(t) < 0.5 for t in b.column("text").to_pylist()], pa.bool_())
            yield b.filter(ok)

    return docs.mapInArrow(kept, docs.schema)
