"""Token ids of whole texts from the tokenizers library, with a cache of its pieces.

Both vocabularies here split a text by a regular expression and encode every piece by
itself, so a piece's ids can be kept. Texts in which this module's expression might
differ from the library's (characters beyond the Latin blocks, or the strings of
special tokens, which get the special tokens' ids as the library gives them) go to the
library whole. A cache has at most CACHE pieces, and as many of the one before it, out of
which frequent pieces come back without being encoded again.
"""

from __future__ import annotations

import re
import sys
from array import array as _array

import numpy as np

CACHE = 300_000


def _visible() -> dict[int, str]:
    """Byte-level vocabularies write a byte as a visible character: itself, or the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Pieces(dict):
    """Pieces' ids, taken from the cache before or found when first asked for."""

    def __init__(self, find, before: dict | None = None):
        self.find, self.before = find, before or {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        self[piece] = ids = self.find(piece) if ids is None else ids
        return ids


class Ids:
    """encode(texts): for each, its ids as little-endian unsigned 16 or 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        kind = type(self.tokenizer.pre_tokenizer).__name__
        lower = self.tokenizer.normalizer is not None
        safe = self._safe()
        # of safe characters, these are all letters, and 0 to 9 all digits
        letters = "".join(f"\\u{ord(c):04x}" for c in safe if c.isalpha())
        if kind == "ByteLevel" and not lower:
            self.split = re.compile(rf" ?[{letters}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s0-9{letters}]+|\s+(?!\S)|\s+").findall
            self.normal = None
        elif kind == "Sequence" and lower:
            self.split = re.compile(rf"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s0-9{letters}]+").findall
            self.normal = str.lower
        else:
            self.split = None
        self.other = re.compile("[^" + "".join(f"\\u{ord(c):04x}" for c in safe) + "]").search
        self.controls = [chr(c) for c in range(128) if chr(c) not in set(safe)]
        self.cache = _Pieces(self._piece)
        self.table = _visible()
        self.code = "H" if self.kind.itemsize == 2 else "I"

    @staticmethod
    def _safe() -> list[str]:
        """Latin characters and common punctuation on whose class Python and the library agree, and that no normal form changes."""
        import unicodedata as u

        out = []
        for c in map(chr, [*range(0x180), *range(0x2010, 0x205F), 0x20AC]):
            k = u.category(c)
            same = bool(re.match(r"[^\W\d_]", c)) == (k[0] == "L") and bool(re.match(r"\d", c)) == (k[0] == "N")
            space = bool(re.match(r"\s", c)) == (c in "\t\n\x0b\x0c\r \x85\xa0" or k in ("Zs", "Zl", "Zp"))
            if same and space and u.normalize("NFC", c) == c and c not in "\u0130\u0149\u017f":
                out.append(c)
        return out

    def unsafe(self, text: str) -> bool:
        if "<|" in text:
            return True
        return any(c in text for c in self.controls) if text.isascii() else bool(self.other(text))

    def _piece(self, piece: str) -> bytes:
        return self._pack([x.id for x in self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.table))])

    def _pack(self, ids: list[int]) -> bytes:
        a = _array(self.code, ids)
        if sys.byteorder == "big":
            a.byteswap()
        return a.tobytes()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.split:
            return self.whole(texts)
        out: list[bytes | None] = [None] * len(texts)
        if len(self.cache) > CACHE:
            self.cache = _Pieces(self._piece, dict(self.cache))
        get, split, normal, unsafe, rest = self.cache.__getitem__, self.split, self.normal, self.unsafe, []
        for i, t in enumerate(texts):
            if unsafe(t):
                rest.append(i)
            else:
                out[i] = b"".join(map(get, split(normal(t) if normal else t)))
        for i, ids in zip(rest, self.whole([texts[i] for i in rest])):
            out[i] = ids
        return out


_made: dict[str, Ids] = {}


def ids(path: str) -> Ids:
    """One for each path in a Python worker."""
    if path not in _made:
        _made[path] = Ids(path)
    return _made[path]
