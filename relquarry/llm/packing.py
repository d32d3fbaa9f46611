"""Packing of documents into sequences along a space-filling curve.

Each document's token ids are hashed to a few dimensions: a fixed table of random
directions holds one row per id, a document's vector is the sum of its ids' rows over
the square root of its length, and the normal distribution function brings each
coordinate into 0..1. The Hilbert key of that cell orders the documents, so that
neighbours on the curve have similar contents. Ranges of the curve go to partitions; in
each, documents are laid end to end and cut at the sequence length.

Padding: a partition's last sequence, which isn't full, is cut into sequences whose
lengths are powers of two; those need no padding, so that none is needed at all.

Defined results. Null text: as empty, which has the end id alone. Null doc_id: kept,
first among equal keys. Repeated rows: each is packed. Ties of a key: by doc_id, then
ids. Very long texts: cut over as many sequences as they need. Empty table: no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import batch, bounds, prepare, sampled, slices, spread

DIMS, BITS = 3, 16
_ROW = pa.schema([("pid", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()), ("m", pa.int64()), ("ids", pa.binary())])
_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys along the Hilbert curve of integer cells (rows), each coordinate below 2**bits (Skilling's transform)."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[:, i] & q) != 0
            t = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(on, p, t)
            x[:, i] ^= t
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[:, n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


_directions: list[np.ndarray] = []


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents given by their token ids; without any: the middle cell's."""
    if not _directions:
        _directions.append(np.random.default_rng(20).standard_normal((1 << 16, DIMS)).astype(np.float32))
    table = _directions[0]
    v = np.zeros((len(ids), DIMS))
    for k, a in enumerate(ids):
        if len(a):
            v[k] = table[a & 0xFFFF].sum(axis=0, dtype=np.float64) / len(a) ** 0.5
    # the logistic curve close to the normal distribution function
    unit = 1 / (1 + np.exp(-1.702 * np.clip(v, -8, 8)))
    return hilbert(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def _encode(batches, path: str, ranges: list[tuple]):
    """Rows with the number of their range of (key, doc_id, m); m parts the rows of one doc_id and key, however many."""
    coder = tokens.ids(path)
    for b in slices(batches):
        docs = b.column("doc_id").to_pylist()
        raw = coder.encode([t or "" for t in b.column("text").to_pylist()])
        keys = curve_keys([np.frombuffer(r, coder.kind) for r in raw])
        places = zip(keys.tolist(), docs, b.column("m").to_pylist())
        pid = [bisect.bisect_right(ranges, (k, -(1 << 63) if d is None else d, m)) for k, d, m in places]
        yield batch(_ROW, pid, keys, docs, b.column("m"), raw)


def _pack(batches, path: str, end: int, length: int):
    kind = tokens.ids(path).kind
    tail = np.array([end], "<u4").tobytes()
    held: list[tuple] = []  # pieces of the sequence that is open: doc, start, bytes, document's tokens
    room, seq, pid = length, 0, 0
    out: list[tuple] = []

    def flush(pieces: list[tuple]):
        nonlocal seq
        at = 0
        for doc, start, data, total in pieces:
            n = len(data) // 4
            out.append((doc, start, n, zlib.crc32(data), total, pid << 40 | seq, at))
            at += n
        seq += 1

    for b in batches:
        for p, doc, raw in zip(b.column("pid").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids")):
            pid = p
            data = memoryview(np.frombuffer(raw.as_buffer(), kind).astype("<u4").tobytes() + tail)
            total, start = len(data) // 4, 0
            while start < total:
                n = min(room, total - start)
                held.append((doc, start, data[4 * start : 4 * (start + n)], total))
                start, room = start + n, room - n
                if not room:
                    flush(held)
                    held, room = [], length
        if out:
            yield batch(_PIECE, *zip(*out))
            out = []
    left = length - room if held else 0
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        some = []
        while size:
            doc, start, data, total = held.pop(0)
            n = min(size, len(data) // 4)
            some.append((doc, start, data[: 4 * n], total))
            if 4 * n < len(data):
                held.insert(0, (doc, start + n, data[4 * n :], total))
            size -= n
        flush(some)
    if out:
        yield batch(_PIECE, *zip(*out))


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, length: int = 1024) -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` ids, a power of two.

    vocabulary: a file of the tokenizers library. end_id: appended to each document.
    Bounds of the curve's ranges come from the keys of a sample; every document is then
    packed. The number of ranges follows the data, and equal keys (of equal texts) are cut
    by doc_id and place in the input. The ids, at two bytes each, are shuffled once.
    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = spread(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.monotonically_increasing_id().alias("m"))
    schema = "pid int, key bigint, doc_id bigint, m bigint, ids binary"
    n, some = sampled(docs)
    size = F.length("ids").alias("size")
    seen = some.mapInArrow(partial(_encode, path=vocabulary, ranges=[]), schema).select("key", F.coalesce("doc_id", F.lit(-(1 << 63))), "m", size).collect()
    ranges = bounds(spark, n, list(map(tuple, seen)))
    rows = docs.mapInArrow(partial(_encode, path=vocabulary, ranges=ranges), schema).drop("m")
    rows = rows.repartitionById(len(ranges) + 1, F.col("pid")).sortWithinPartitions("key", "doc_id", "ids")
    return rows.mapInArrow(partial(_pack, path=vocabulary, end=end_id, length=length), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
