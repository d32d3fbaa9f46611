"""Tokenizers as column expressions; Arrow UDFs only where no expression will do."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import word_list

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
#: A word may go on with + # - but not begin so.
TOKEN = rf"{WORD}[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}+#-]*"
_ROMAN = {chr(0x2160 + i): r for i, r in enumerate("i ii iii iv v vi vii viii ix x xi xii l c d m".split())} | {chr(0x2170 + i): r for i, r in enumerate("i ii iii iv v vi vii viii ix x xi xii l c d m".split())}
_UMLAUT = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "þ": "th", "ð": "d", "ı": "i", "ĳ": "ij", "ŀ": "l", "ŋ": "n", "ŧ": "t", "ħ": "h", "ſ": "s"}


def fold(text: str | None) -> str | None:
    """Lower case without diacritics, ligatures, combining marks or letter-like numerals; umlauts as two letters."""
    if text is None:
        return None
    if text.isascii():
        return text.lower()
    out = []
    for c in unicodedata.normalize("NFC", text).lower():
        if c.isascii():
            out.append(c)
        elif c in _UMLAUT:
            out.append(_UMLAUT[c])
        elif c in _ROMAN:
            out.append(_ROMAN[c])
        else:
            for d in unicodedata.normalize("NFKD", c):
                if not unicodedata.combining(d):
                    out.append(_UMLAUT.get(d, d))
    return "".join(out)


#: Characters of the texts of which a Python worker holds the results at once.
PIECE = 4 << 20
_KINDS = {"string": (T.StringType(), pa.string()), "array<string>": (T.ArrayType(T.StringType()), pa.list_(pa.string()))}


def by_pieces(function, kind: str):
    """Arrow UDF of a function of one text (or None): results are made, and handed on, for a bounded number of characters at a time."""

    outer, inner = _KINDS[kind]

    @F.arrow_udf(outer)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            if not len(b):
                yield pa.array([], inner)
            part, at = np.cumsum(pc.utf8_length(b).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64) // PIECE, 0
            while at < len(b):
                end = max(at + 1, int(np.searchsorted(part, part[at], "right")))
                yield pa.array((function(t.as_py()) for t in b.slice(at, end - at)), inner, size=end - at)
                at = end

    return of


fold_text = by_pieces(fold, "string")


_FOLDED = re.compile(r"[^\W](?:[\w+#-]|['’ʼ](?=\w))*")


def folded_tokens(text: str | None) -> list[str]:
    """Tokens of the folded text; of a word with an apostrophe the left part if it has two bytes or more, else the right."""
    out = []
    for m in _FOLDED.findall(fold(text or "")):
        left, mark, right = re.split("(['’ʼ])", m, maxsplit=1) if re.search("['’ʼ]", m) else (m, "", "")
        out.append(left if not mark or len(left.encode()) >= 2 else re.split("['’ʼ]", right)[0])
    return out


_folded = by_pieces(folded_tokens, "array<string>")


def segment(text: str, dictionary: dict[str, float], longest: int) -> list[str]:
    """Most probable split of a run of characters into dictionary words (log probabilities); unknown characters stand alone."""
    floor = min(dictionary.values(), default=-10.0) - 5
    best: list[tuple[float, int]] = [(0.0, 0)]
    for i in range(1, len(text) + 1):
        choices = [(best[j][0] + dictionary.get(text[j:i], floor if i - j == 1 else -1e9), j) for j in range(max(0, i - longest), i)]
        best.append(max(choices, key=lambda c: (c[0], -c[1])))
    out, i = [], len(text)
    while i:
        out.append(text[best[i][1] : i])
        i = best[i][1]
    return out[::-1]


_HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿]+")


def zh_tokens(text: str | None, dictionary: dict[str, float]) -> list[str]:
    longest = max(map(len, dictionary), default=1)
    out: list[str] = []
    for token in re.findall(r"[^\W][\w+#-]*", (text or "").lower()):
        at = 0
        for m in _HAN.finditer(token):
            if m.start() > at:
                out.append(token[at : m.start()])
            out += segment(m[0], dictionary, longest)
            at = m.end()
        if at < len(token):
            out.append(token[at:])
    return out


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def tokens(text, tokenizer: str = "UnicodeAlphanumeric", dictionary: dict[str, float] | None = None) -> Column:
    """Array of all tokens of a string column, in order; null gives an empty array."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    if tokenizer == "AsciiAlphabetic":
        out = F.regexp_extract_all(ascii_lower(c), F.lit("[a-z]+"), 0)
    elif tokenizer == "UnicodeAlphanumeric":
        out = F.regexp_extract_all(F.lower(c), F.lit(TOKEN), 0)
    elif tokenizer == "UnicodeAlphanumericFolded":
        out = _folded(c)
    elif tokenizer in ("Whitespace", "WhitespaceLowercase"):
        out = F.filter(F.split(ascii_lower(c) if tokenizer == "WhitespaceLowercase" else c, r"\s+"), lambda t: t != "")
    elif tokenizer == "UnicodeAlphanumericZH":
        words = dictionary or {}
        out = by_pieces(lambda t: zh_tokens(t, words), "array<string>")(c)
    else:
        raise ValueError(f"unknown tokenizer {tokenizer}")
    return out


def without(tokens_: Column, stop_words) -> Column:
    stop = word_list(stop_words)
    return F.filter(tokens_, lambda t: ~t.isin(list(stop))) if stop else tokens_


def stemmed(tokens_: Column, stemmer: str | None) -> Column:
    """Tokens through a stemmer; each distinct word of a batch is stemmed once."""
    if not stemmer or stemmer.lower() == "none":
        return tokens_
    from .stemmers import stemmer as make

    name = stemmer

    @F.arrow_udf("array<string>")
    def apply(lists: pa.Array) -> pa.Array:
        stem, words = make(name), lists.flatten().dictionary_encode()
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int32)
        stems = pa.array([stem(t) for t in words.dictionary.to_pylist()], pa.string())
        return pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), ends)), stems.take(words.indices))

    return apply(tokens_)


def analyze(text, meta) -> Column:
    """The token column of an index's settings: tokenizer, stop words, stemmer, in this order."""
    return stemmed(without(tokens(text, meta.tokenizer, log_dictionary(meta.zh_dictionary)), meta.stop_words), meta.stemmer)


def log_dictionary(words) -> dict[str, float]:
    """Log probabilities of (word, frequency) pairs."""
    total = sum(n for _, n in words)
    return {w: log(n / total) for w, n in words if n > 0}


def quantized_length(n: Column) -> Column:
    """A length as one byte can hold it: exact under 40, then with a 4-bit mantissa."""
    rest = n.cast("int") - 24
    shift = F.greatest(F.length(F.bin(F.greatest(rest, F.lit(1)))) - 4, F.lit(0))
    return F.when(n < 32, n.cast("int")).otherwise(F.lit(24) + F.call_function("shiftleft", F.call_function("shiftright", rest, shift), shift))


def length_to_byte(n: int) -> int:
    """Byte code of a length."""
    if n < 40:
        return n if n < 24 else n
    rest = n - 24
    shift = rest.bit_length() - 4
    return 24 + ((shift + 1) << 3 | (rest >> shift & 7))


def byte_to_length(b: int) -> int:
    """Length of a byte code; the largest length not above those with the code."""
    if b < 40:
        return b
    shift, low = ((b - 24) >> 3) - 1, (b - 24) & 7
    return 24 + ((8 | low) << shift)


def json_strings(value) -> str:
    """String values at all levels, in order, joined by spaces; a top-level scalar as text."""
    out: list[str] = []

    def walk(v):
        if isinstance(v, str):
            out.append(v)
        elif isinstance(v, dict):
            for x in v.values():
                walk(x)
        elif isinstance(v, list):
            for x in v:
                walk(x)

    walk(value)
    return " ".join(out) if isinstance(value, (str, dict, list)) else "" if value is None else str(value)


@F.pandas_udf(T.StringType())
def json_text(s: pd.Series) -> pd.Series:
    import json

    def one(t):
        try:
            return json_strings(json.loads(t))
        except (TypeError, ValueError):
            return t

    return s.map(one, na_action="ignore")


def chunks(text: str | None, size: int = 1000) -> list[str]:
    """Pieces of whole sentences (ending in line feed . ? !) of at most ``size`` bytes; longer sentences are cut at spaces."""
    out: list[str] = []
    now = ""
    for s in re.findall(r"[^\n.?!]*[\n.?!]+|[^\n.?!]+", text or ""):
        while len(s.encode()) > size:
            if now.strip():
                out.append(now.strip())
                now = ""
            head = s.encode()[:size].decode(errors="ignore")
            cut = head.rfind(" ") + 1 or len(head)
            out.append(s[:cut].strip())
            s = s[cut:]
        if len((now + s).encode()) > size:
            out.append(now.strip())
            now = ""
        now += s
    if now.strip():
        out.append(now.strip())
    return [c for c in out if c]


def chunk_text_of(size: int):
    """Arrow UDF: a text's chunks of at most ``size`` bytes."""
    return by_pieces(lambda t: chunks(t, size), "array<string>")


chunk_text = chunk_text_of(1000)


def substring(c: Column, start: int, length: int) -> Column:
    """``length`` characters from the zero-based ``start`` on."""
    return F.substring(c, start + 1, length)


def truncate(c: Column, length: int) -> Column:
    return F.left(c, F.lit(length))


def encode_base64(c: Column) -> Column:
    return F.base64(F.encode(c, "UTF-8"))


def decode_base64(c: Column) -> Column:
    return F.decode(F.unbase64(c), "UTF-8")
