"""Token ids in binary files, with Elias-Fano document boundaries.

A folder has files for ranges of doc_id, in ascending order, and manifest.json. A file is
MAGIC, the ids of all its documents end to end (2 bytes each where the vocabulary allows,
else 4), document boundaries and doc_ids, both in Elias-Fano form, a header (JSON), the
header's length (4 bytes) and MAGIC again. The ids are streamed into it: a writer holds 16
bytes a document of the file that is open, and starts another at FILE_IDS ids or
FILE_DOCS documents. A reader takes a run of documents of a file: select finds its
boundaries, and only the run's ids are read.

Elias-Fano form of n non-decreasing numbers below u: the low floor(log2(u/n)) bits of
each, and the rest in unary in a bit vector, about 2 + log2(u/n) bits a number. Every
256th one bit's place is kept (4 bytes), so that select finds any number in a short scan.

Defined results. Null text: as empty, the end id alone. Null doc_id: first. Repeated
rows: one entry each; equal doc_ids in the order of their text's hash. Very long texts:
whole, in one file. Empty table: a manifest without files, and no rows. Other columns are
ignored.
"""

from __future__ import annotations

import bisect
import json
import struct
import uuid
import zlib
from array import array as _array
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import batch, bounds, prepare, sampled, slices, spread

MAGIC, EVERY = b"TOKEF002", 256
#: Where a writer starts another file, and the ids that a reader holds at a time.
FILE_IDS, FILE_DOCS, READ_IDS = 1 << 27, 1 << 22, 1 << 21
_ROW = pa.schema([("pid", pa.int32()), ("doc_id", pa.int64()), ("h", pa.int64()), ("ids", pa.binary())])
_META = pa.schema([("part", pa.int32()), ("no", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_DOC = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


class EliasFano:
    """n non-decreasing numbers from 0 on."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, places: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.places = n, low_bits, low, high, places

    @classmethod
    def of(cls, v: np.ndarray) -> EliasFano:
        v = np.asarray(v, np.uint64)
        n = len(v)
        bits = max(0, int(int(v[-1]) // n).bit_length() - 1) if n else 0
        low = np.packbits((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1), bitorder="little") if bits and n else np.zeros(0, np.uint8)
        at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        ones = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        ones[at] = 1
        return cls(n, bits, low, np.packbits(ones, bitorder="little"), at[::EVERY].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.places)) + self.low.tobytes() + self.high.tobytes() + self.places.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, b: memoryview) -> EliasFano:
        n, bits, a, h, p = struct.unpack_from("<QBQQQ", b)
        i = struct.calcsize("<QBQQQ")
        return cls(n, bits, np.frombuffer(b, np.uint8, a, i), np.frombuffer(b, np.uint8, h, i + a), np.frombuffer(b, "<u4", p, i + a + h))

    def _low(self, i: int) -> int:
        a = i * self.low_bits
        piece = int.from_bytes(self.low[a >> 3 : (a + self.low_bits + 7) >> 3].tobytes(), "little")
        return piece >> (a & 7) & ((1 << self.low_bits) - 1)

    def _place(self, i: int) -> int:
        """Bit of the high part that is number i's one, from the nearest kept place on."""
        at = int(self.places[i // EVERY])
        left, byte = i % EVERY, at >> 3
        now = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (ones := now.bit_count()) <= left:
            left -= ones
            byte += 1
            now = int(self.high[byte])
        for _ in range(left):
            now &= now - 1
        return byte * 8 + (now & -now).bit_length() - 1

    def select(self, i: int) -> int:
        """Number i."""
        return (self._place(i) - i) << self.low_bits | self._low(i)

    def run(self, i: int, j: int) -> np.ndarray:
        """Numbers i to j - 1: the bits between the two selected places, and no others, are unpacked."""
        if i >= j:
            return np.zeros(0, np.int64)
        a, z = self._place(i), self._place(j - 1)
        ones = np.flatnonzero(np.unpackbits(self.high[a >> 3 : (z >> 3) + 1], bitorder="little")[a & 7 : z - (a >> 3 << 3) + 1])
        high = ones + a - np.arange(i, j)
        if not self.low_bits:
            return high
        s, e = i * self.low_bits, j * self.low_bits
        bits = np.unpackbits(self.low[s >> 3 : (e + 7) >> 3], bitorder="little")[s & 7 : (s & 7) + e - s].reshape(j - i, self.low_bits).astype(np.int64)
        return high << self.low_bits | (bits << np.arange(self.low_bits)).sum(axis=1)


def _encode(batches, path: str, ranges: list[tuple]):
    """Rows with the number of their range of (doc_id, nulls first, text's hash, m); m parts equal rows, however many."""
    coder = tokens.ids(path)
    for b in slices(batches):
        docs = b.column("doc_id")
        raw = coder.encode([t or "" for t in b.column("text").to_pylist()])
        places = zip(docs.to_pylist(), b.column("h").to_pylist(), b.column("m").to_pylist())
        pid = [bisect.bisect_right(ranges, (d is not None, d or 0, h, m)) for d, h, m in places]
        yield batch(_ROW, pid, docs, b.column("h"), raw)


class _Writer:
    """A file that ids are streamed into; doc_ids ascend, nulls first."""

    def __init__(self, folder: str, name: str, kind: np.dtype):
        self.where, at = _open(folder)
        self.name, self.kind, self.path = name, kind, f"{at}/{name}"
        self.fresh = f"{at}/.{name}.{uuid.uuid4().hex}"  # a task that runs twice leaves one whole file
        self.stream = self.where.open_output_stream(self.fresh)
        self.stream.write(MAGIC)
        self.held, self.ends, self.docs, self.nulls, self.total = bytearray(), _array("Q"), _array("q"), 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.held += ids
        self.total += len(ids) // self.kind.itemsize
        self.ends.append(self.total)
        if doc_id is None:
            self.nulls += 1
        else:
            self.docs.append(doc_id)
        if len(self.held) >= 4 << 20:
            self.stream.write(bytes(self.held))
            self.held.clear()

    def full(self) -> bool:
        return self.total >= FILE_IDS or len(self.ends) >= FILE_DOCS

    def close(self) -> tuple[str, int, int]:
        first = self.docs[0] if self.docs else 0
        known = np.frombuffer(self.docs, np.int64).view(np.uint64) - np.uint64(first & (1 << 64) - 1) if self.docs else np.zeros(0, np.uint64)
        sections = [EliasFano.of(np.frombuffer(self.ends, np.uint64)).to_bytes(), EliasFano.of(known).to_bytes()]
        header = json.dumps({"documents": len(self.ends), "ids": self.total, "width": self.kind.itemsize, "null_doc_ids": self.nulls, "first_doc_id": first, "sections": [len(s) for s in sections]}).encode()
        self.stream.write(b"".join([bytes(self.held), *sections, header, struct.pack("<I", len(header)), MAGIC]))
        self.stream.close()
        self.where.move(self.fresh, self.path)
        return self.name, len(self.ends), self.total


class TokenFile:
    """A file that is read by runs of its documents: ``span(i)``, ``ids(i)`` and ``doc_id(i)`` of document i, ``spans`` and ``doc_ids`` of a run."""

    def __init__(self, file):
        self.file, tail = file, len(MAGIC) + 4
        size = file.size()
        end = self._read(size - tail, tail) if size >= tail else b""
        if end[4:] != MAGIC or self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        n = struct.unpack_from("<I", end)[0]
        self.header = h = json.loads(self._read(size - tail - n, n))
        x, y = h["sections"]
        b = memoryview(self._read(size - tail - n - x - y, x + y))
        self.ends, self.docs = EliasFano.from_bytes(b[:x]), EliasFano.from_bytes(b[x:])
        self.kind = np.dtype(f"<u{h['width']}")

    @classmethod
    def of(cls, data: bytes) -> TokenFile:
        return cls(pa.BufferReader(data))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def __len__(self) -> int:
        return self.header["documents"]

    def values(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop - 1 of the file."""
        w = self.kind.itemsize
        return np.frombuffer(self._read(len(MAGIC) + start * w, (stop - start) * w), self.kind)

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def spans(self, i: int, j: int) -> np.ndarray:
        """Boundaries of documents i to j - 1: where each starts, and where the last ends."""
        return self.ends.run(i - 1, j) if i else np.concatenate([[0], self.ends.run(0, j)])

    def ids(self, i: int) -> np.ndarray:
        return self.values(*self.span(i))

    def doc_id(self, i: int) -> int | None:
        nulls = self.header["null_doc_ids"]
        return None if i < nulls else self.header["first_doc_id"] + self.docs.select(i - nulls)

    def doc_ids(self, i: int, j: int) -> pa.Array:
        nulls = self.header["null_doc_ids"]
        known = self.docs.run(max(i - nulls, 0), max(j - nulls, 0)) + self.header["first_doc_id"]
        return pa.concat_arrays([pa.nulls(j - i - len(known), pa.int64()), pa.array(known, pa.int64())])


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or ":" in uri.split("/")[0] else f"file://{uri}")


def _write(batches, path: str, end: int, folder: str):
    kind = tokens.ids(path).kind
    tail, out, no = np.array([end], kind).tobytes(), None, 0
    for b in batches:
        for pid, doc, raw in zip(b.column("pid").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids")):
            out = out or _Writer(folder, f"part-{pid:06d}-{no:04d}.tok", kind)
            out.add(doc, raw.as_buffer().to_pybytes() + tail)
            if out.full():
                yield batch(_META, [pid], [no], *([x] for x in out.close()))
                out, no = None, no + 1
    if out:
        yield batch(_META, [pid], [no], *([x] for x in out.close()))


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, end_id: int) -> dict:
    """Encode every document and write the files; returns the manifest.

    folder: a URI that driver and executors share. The ranges of doc_id come from a sample,
    have about as much text as each other and follow the data in number; one row a file
    returns to the driver. The ids are shuffled once.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = spread(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64(F.col("text").cast("string")).alias("h"), F.monotonically_increasing_id().alias("m"))
    n, some = sampled(docs)
    known, size = F.col("doc_id").isNotNull(), F.coalesce(F.octet_length("text"), F.lit(0))
    ranges = bounds(spark, n, list(map(tuple, some.select(known, F.coalesce("doc_id", F.lit(0)), "h", "m", size).collect())))
    where, at = _open(folder)
    where.create_dir(at, recursive=True)
    rows = docs.mapInArrow(partial(_encode, path=vocabulary, ranges=ranges), "pid int, doc_id bigint, h bigint, ids binary")
    rows = rows.repartitionById(len(ranges) + 1, F.col("pid")).sortWithinPartitions("doc_id", "h")
    parts = sorted(map(tuple, rows.mapInArrow(partial(_write, path=vocabulary, end=end_id, folder=folder), "part int, no int, name string, n_docs bigint, n_ids bigint").collect()))
    manifest = {"end_id": end_id, "files": [{"name": p[2], "documents": p[3], "ids": p[4]} for p in parts]}
    with where.open_output_stream(f"{at}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def _read(batches, folder: str, with_ids: bool):
    where, at = _open(folder)
    for b in batches:
        for name, base, first, last in zip(*(b.column(c).to_pylist() for c in ("name", "base", "first", "last"))):
            with where.open_input_file(f"{at}/{name}") as f:
                t = TokenFile(f)
                while first < last:
                    # as many documents as have READ_IDS ids, one at least
                    edges = t.spans(first, min(last, first + 4096))
                    n = max(1, int(np.searchsorted(edges, edges[0] + READ_IDS, side="right")) - 1)
                    edges = edges[: n + 1]
                    values = t.values(int(edges[0]), int(edges[-1]))
                    cut = (edges - edges[0]).tolist()
                    wide = memoryview(values.astype("<u4").tobytes())
                    crc = [zlib.crc32(wide[4 * a : 4 * e]) for a, e in zip(cut, cut[1:])]
                    ids = [values[a:e].tobytes() for a, e in zip(cut, cut[1:])] if with_ids else pa.nulls(n, pa.binary())
                    yield batch(_DOC, t.doc_ids(first, first + n), edges[:-1] + base, np.diff(edges), crc, ids)
                    first += n


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, ids (as stored; null unless with_ids), from the files.

    A file is read in several tasks where it has much: runs of its documents, of about 16 times READ_IDS ids.
    """
    prepare(spark)
    where, at = _open(folder)
    with where.open_input_file(f"{at}/manifest.json") as f:
        files = json.loads(f.read())["files"]
    base = np.cumsum([0, *(x["ids"] for x in files)]).tolist()
    rows = []
    for x, b in zip(files, base):
        runs = max(1, min(x["documents"], x["ids"] // (16 * READ_IDS)))
        cut = [x["documents"] * k // runs for k in range(runs + 1)]
        rows += [(len(rows) + k, x["name"], b, *c) for k, c in enumerate(zip(cut, cut[1:]))]
    parts = spark.createDataFrame(rows, "k int, name string, base bigint, first bigint, last bigint").repartitionById(max(1, len(rows)), F.col("k"))
    return parts.mapInArrow(partial(_read, folder=folder, with_ids=with_ids), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
