"""Fuzzy line deduplication by MinHash.

A line's class is found on its normal form: lower case, white space as single spaces.
1. Every document is scanned once. A line becomes a 64-bit hash of its normal form (equal
   lines are one from here on) and, where it has WORTH characters or more, BANDS band keys
   of ROWS MinHash values each over its SHINGLE-character shingles.
2. Lines that share a band key are candidates. A key's lines are paired with its smallest
   line only. Where verification left a key's lines in different classes, the others of up
   to SMALL are paired, too, and those of larger keys meet by an exact prefix join: their shingles in one order, the rarest first, and two lines at the
   threshold share one of the first ninth of the smaller's and the first fifth of the
   larger's, at places that leave room for the overlap. So a key with many similar lines
   costs a pair for each, one with many lines that share a common part but aren't similar
   costs their rare shingles, and no similar pair stays uncompared.
3. Pairs are verified by the exact Jaccard index of their shingle sets, at THRESHOLD. Before
   that, pairs go of which so few of VALUES MinHash values agree as 7 in 10,000 pairs do at
   the threshold. Only candidate lines move.
4. Union-find over verified pairs; of each class the first line stays, by doc_id, then
   line number.

Defined results. Null text: no lines. Empty text: one empty line. Lines without characters
other than white space are always kept and belong to no class. Lines shorter than a
shingle are copies only if equal in normal form. Null doc_id:
its lines are treated as those of the last document. Repeated rows (doc_id and text alike)
are one document: they keep the same lines. Rows of one doc_id with other texts are told
apart by the text's hash. Ties: none left. Very long texts and lines: whole. Empty table:
no rows. Other columns are kept by ``deduplicate`` and ignored by ``line_classes``.
"""

from __future__ import annotations

from functools import partial
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, keep, prepare, slices, spread
from .components import components

SHINGLE, ROWS, BANDS, THRESHOLD, WORTH, SEEN = 8, 4, 9, 0.8, 8, 200_000  # WORTH: SHINGLE, so that all lines with a shingle have bands
#: Places of the table that orders shingles by frequency; lines of a shingle that one join task holds.
PLACES, HOT = 1 << 20, 2000
#: Lines of a key that are paired without more ado: at most half as many pairs a line.
SMALL = 16
#: Rows of a key that are put in order in memory.
HELD = 1 << 18
#: MinHash values, of a byte each, that are compared before texts are.
VALUES = 128
_LINE = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("line_no", pa.int32()), ("h", pa.int64()), ("bands", pa.list_(pa.int64()))])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_STAR = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
_TEXT = pa.schema([("h", pa.int64()), ("line", pa.string()), ("sig", pa.binary())])
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PERMS = np.random.default_rng(1).integers(1, 1 << 32, (2, VALUES), dtype=np.uint64).astype(np.uint32) | np.uint32(1)

#: What str.split takes for white space, but for the space and the line's end.
_WHITE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def forms(text: str) -> list[str]:
    """Normal forms of a text's lines."""
    low = text.lower()
    lines = low.split("\n")
    if any(c in low for c in _WHITE):
        return [" ".join(line.split()) for line in lines]
    # most texts are normal as they stand
    if "  " not in low and " \n" not in low and "\n " not in low and not low.startswith(" ") and not low.endswith(" "):
        return lines
    return [" ".join(line.split()) if "  " in line or line.startswith(" ") or line.endswith(" ") else line for line in lines]


def line_hash(form: str) -> int:
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(form)
    return h - (1 << 64) if h >> 63 else h


def shingles(form: str) -> set[str]:
    return {form[i : i + SHINGLE] for i in range(max(1, len(form) - SHINGLE + 1))}


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def signatures(forms: list[str], values: int = ROWS * BANDS) -> np.ndarray:
    """MinHash values (rows: lines) of normal forms of at least SHINGLE characters."""
    out = np.empty((len(forms), values), np.uint32)
    step = 1 << 16  # characters at a time, so that the arrays stay in the processor's cache
    i = 0
    while i < len(forms):
        j, n = i, 0
        while j < len(forms) and (j == i or n + len(forms[j]) <= step):
            n += len(forms[j])
            j += 1
        out[i:j] = _signatures(forms[i:j], values)
        i = j
    return out


def _rolled(c: np.ndarray) -> np.ndarray:
    """A hash of every SHINGLE characters in a row."""
    p2 = c[:-1] * np.uint64(0x1000193) + c[1:]
    p4 = p2[:-2] * np.uint64(0x9E3779B97F4A7C55) + p2[2:]
    return p4[:-4] * np.uint64(0xD6E8FEB86659FD93) + p4[4:]


def _signatures(forms: list[str], values: int) -> np.ndarray:
    c = np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    p8 = _rolled(c)
    h = ((p8 ^ (p8 >> np.uint64(32))) * _M1 >> np.uint64(32)).astype(np.uint32)
    ends = np.cumsum([len(f) for f in forms])
    cuts = np.empty(2 * len(forms), np.int64)
    cuts[::2] = np.concatenate([[0], ends[:-1]])
    cuts[1::2] = ends - SHINGLE + 1
    cuts = cuts[:-1]  # the last line's shingles are the last
    low, t = np.empty((values, len(forms)), np.uint32), np.empty_like(h)
    for k in range(values):
        np.bitwise_xor(h, _PERMS[0, k], out=t)
        np.multiply(t, _PERMS[1, k], out=t)
        low[k] = np.minimum.reduceat(t, cuts)[::2]
    return low.T


def bands(forms: list[str]) -> np.ndarray:
    """Band keys (rows: lines) of normal forms of at least SHINGLE characters."""
    low = signatures(forms).astype(np.uint64).reshape(-1, BANDS, ROWS)
    key = np.zeros((len(forms), BANDS), np.uint64)
    for r in range(ROWS):
        key = (key ^ low[:, :, r]) * _M1
        key ^= key >> np.uint64(29)
    return ((key + np.arange(BANDS, dtype=np.uint64)) * _M2).view(np.int64)


def _signed(hashes: list[int]) -> np.ndarray:
    return np.array(hashes, np.uint64).view(np.int64)


def _scan(batches):
    from xxhash import xxh64_intdigest

    seen: set[int] = set()
    for b in slices(batches):
        text_hash, many, no, hs, new, at = [], [], [], [], [], []
        for t in b.column("text").to_pylist():
            before = len(hs)
            if t is not None:
                for k, form in enumerate(forms(t)):
                    if form:
                        h = xxh64_intdigest(form)  # as line_hash
                        if h not in seen and len(form) >= WORTH:
                            seen.add(h)
                            new.append(form)
                            at.append(len(hs))
                        no.append(k)
                        hs.append(h)
            text_hash.append(0 if t is None else xxh64_intdigest(t, 42))  # as Spark's xxhash64
            many.append(len(hs) - before)
        if len(seen) > SEEN:
            seen.clear()
        sizes = np.zeros(len(hs) + 1, np.int32)
        sizes[np.array(at, int) + 1] = BANDS
        values = bands(new).ravel() if new else np.zeros(0, np.int64)
        doc = b.column("doc_id").take(pa.array(np.repeat(np.arange(b.num_rows), many)))
        yield batch(_LINE, doc, np.repeat(_signed(text_hash), many), no, _signed(hs), pa.ListArray.from_arrays(np.cumsum(sizes, dtype=np.int32), values))


def _star(key: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    """Stars of whole keys, of which each is in one piece."""
    new = np.ones(len(key) + 1, bool)
    np.not_equal(key[1:], key[:-1], out=new[1:-1])
    several = ~(new[:-1] & new[1:])
    key, h = key[several], h[several]
    order = np.lexsort((h, key))
    key, h = key[order], h[order]
    same = np.zeros(len(key), bool)
    np.equal(key[1:], key[:-1], out=same[1:])
    first = h[np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))]
    same[1:] &= h[1:] != h[:-1]
    return batch(_STAR, key[same], first[same], h[same])


def _stars(batches):
    """(key, a, b): each key's smallest line with each of its others. Rows come in the order of key only, which is what Spark sorts fast; a line that several workers sent is there repeatedly.

    Of a key with more than HELD rows it is the smallest of those that came first, and its others may come repeatedly.
    """
    held = np.zeros(0, np.int64), np.zeros(0, np.int64)  # rows of the key that may go on
    centre = None  # key of more than HELD rows, its line
    for b in batches:
        key, h = (np.concatenate([x, b.column(k).to_numpy(zero_copy_only=False)]) for k, x in enumerate(held))
        if centre and len(key) and key[0] == centre[0]:
            n = int(np.searchsorted(key, key[0], "right"))
            other = np.unique(h[:n])
            other = other[other != centre[1]]
            yield batch(_STAR, np.full(len(other), centre[0]), np.full(len(other), centre[1]), other)
            key, h = key[n:], h[n:]
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if len(key) - cut > HELD:
            centre = key[-1], h[cut:].min()
            cut = len(key)
        yield _star(key[:cut], h[:cut])
        held = key[cut:], h[cut:]
    yield _star(*held)


def _lines_of(batches, bits: np.ndarray):
    """Normal forms of the lines that a bit table knows; each once a worker."""
    from xxhash import xxh64_intdigest

    mask, sent = np.uint64(len(bits) * 8 - 1), set()
    for b in slices(batches):
        found = [form for t in b.column("text").to_pylist() if t is not None for form in forms(t) if len(form) >= WORTH]
        if found:
            hs = [xxh64_intdigest(form) for form in found]
            at = np.array(hs, np.uint64) & mask
            hit = np.flatnonzero(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
            new = []
            for i in hit.tolist():
                if hs[i] not in sent:
                    sent.add(hs[i])
                    new.append(i)
            if len(sent) > SEEN:
                sent.clear()
            lines = [found[i] for i in new]
            sig = np.ascontiguousarray(signatures(lines, VALUES).astype(np.uint8))
            ends = np.arange(0, sig.size + 1, VALUES, dtype=np.int32)
            yield batch(_TEXT, _signed([hs[i] for i in new]), lines, pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(ends), pa.py_buffer(sig)]))


def _likely(batches, threshold: float):
    """Pairs that their signatures leave open: at most 3.2 deviations of the binomial distribution below the threshold."""
    least = threshold * VALUES - 3.2 * (VALUES * threshold * (1 - threshold)) ** 0.5
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(b.num_rows, VALUES) for k in ("sa", "sb"))
        ok = (x == y).sum(axis=1) >= least
        yield batch(_PAIR, *(b.column(k).filter(pa.array(ok)) for k in ("a", "b")))


def distinct(numbers: np.ndarray) -> np.ndarray:
    """As np.unique, which hashes first and takes several times as long for a line's few hundred numbers."""
    x = np.sort(numbers)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def packed(form: str) -> np.ndarray | None:
    """The distinct shingles of a form of SHINGLE characters or more as 8-byte numbers, one for one, in order; None if a character needs more than a byte."""
    try:
        data = form.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return distinct(np.ndarray((len(data) - SHINGLE + 1,), "<u8", data, 0, (1,)))


def packed_shingles(form: str) -> set[int] | None:
    numbers = packed(form)
    return None if numbers is None else set(numbers.tolist())


def similar(s: np.ndarray, t: np.ndarray, threshold: float) -> bool:
    """Whether the sets of two arrays of distinct numbers have the threshold by their exact Jaccard index."""
    n, m = len(s), len(t)
    if min(n, m) < threshold * max(n, m):
        return False
    x = np.concatenate([s, t])
    x.sort()
    both = int(np.count_nonzero(x[1:] == x[:-1]))
    return both / (n + m - both) >= threshold


def _verify(batches, threshold: float):
    kept: dict[int, np.ndarray | None] = {}
    size = 0

    def of(h: int, form: str) -> np.ndarray | None:
        nonlocal size
        if h not in kept:
            if size > 2_000_000:  # shingles, of 8 bytes
                kept.clear()
                size = 0
            s = kept[h] = packed(form)
            size += 20 if s is None else 20 + len(s)
        return kept[h]

    for b in batches:
        a, c, x, y = (b.column(k).to_pylist() for k in range(4))
        good = []
        for i in range(b.num_rows):
            s, t = of(a[i], x[i]), of(c[i], y[i])
            if s is not None and t is not None:
                near = similar(s, t, threshold)
            else:
                s, t = shingles(x[i]), shingles(y[i])
                near = min(len(s), len(t)) >= threshold * max(len(s), len(t)) and jaccard(s, t) >= threshold
            if near:
                good.append(i)
        yield batch(_PAIR, [a[i] for i in good], [c[i] for i in good])


def _ordered(form: str, counts: np.ndarray | None = None) -> np.ndarray:
    """Hashes of a form's distinct shingles, the rarest first; any order that all lines share gives the same pairs. Equal hashes of unequal shingles only cost a comparison."""
    h = distinct(_rolled(np.frombuffer(form.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)) * _M1)
    h ^= h >> np.uint64(32)
    return h if counts is None else h[np.lexsort((h, counts[h & np.uint64(PLACES - 1)]))]


def _count(batches):
    total = np.zeros(PLACES, np.int64)
    for b in slices(batches, "line"):
        h = [_ordered(form) & np.uint64(PLACES - 1) for form in b.column("line").to_pylist()]
        if h:
            total += np.bincount(np.concatenate(h).astype(np.int64), minlength=PLACES)
    at = np.flatnonzero(total)
    yield batch(pa.schema([("place", pa.int32()), ("n", pa.int64())]), at.astype(np.int32), total[at])


_PREFIX = pa.schema([("token", pa.int64()), ("h", pa.int64()), ("top", pa.int64()), ("size", pa.int32()), ("at", pa.int32()), ("first", pa.bool_())])


def _prefixes(batches, counts: np.ndarray, threshold: float):
    """The shingles that a line's partners may be found by: (token, h, top, size, place, whether it will do for a larger partner)."""
    for b in slices(batches, "line"):
        out = []
        for h, top, form in zip(*(b.column(c).to_pylist() for c in ("h", "top", "line"))):
            s = _ordered(form, counts).view(np.int64)
            n = len(s)
            wide = n - ceil(threshold * n - 1e-9) + 1
            narrow = n - ceil(2 * threshold / (1 + threshold) * n - 1e-9) + 1
            out += [(t, h, top, n, i, i < narrow) for i, t in enumerate(s[:wide].tolist())]
        if out:
            yield batch(_PREFIX, *zip(*out))


def prefix_pairs(lines: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a < b of all pairs of lines (h, top, line; of a shingle and more) of different ``top`` that may have the threshold."""
    spark = lines.sparkSession
    rows = lines.mapInArrow(_count, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(PLACES, np.int64)
    counts[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    table = spark.sparkContext.broadcast(counts)
    rows = keep(lines.mapInArrow(lambda batches: _prefixes(batches, table.value, threshold), "token bigint, h bigint, top bigint, size int, at int, first boolean"))
    hot = rows.where("first").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("token", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    rows = rows.join(hot, "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    small = rows.where("first").withColumn("part", F.expr("pmod(h, parts)"))
    large = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    room = f"least(p.size - p.at, q.size - q.at) >= {threshold / (1 + threshold)!r} * (p.size + q.size) - 1e-6"
    meet = f"p.token = q.token and p.part = q.part and p.top <> q.top and (p.size < q.size or p.size = q.size and p.h < q.h) and p.size >= {threshold!r} * q.size - 1e-6 and {room}"
    return small.alias("p").join(large.alias("q"), F.expr(meet)).select(F.expr("least(p.h, q.h)").alias("a"), F.expr("greatest(p.h, q.h)").alias("b")).distinct()


def line_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per line that isn't blank: doc_id, text_hash, line_no, first_doc_id, first_line_no (the line of its class that stays), kept."""
    spark = docs.sparkSession
    prepare(spark)
    docs = spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
    lines = keep(docs.mapInArrow(_scan, "doc_id bigint, text_hash bigint, line_no int, h bigint, bands array<bigint>"))
    keys = lines.where("bands is not null and size(bands) > 0").select(F.explode("bands").alias("key"), "h")
    stars = keep(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_stars, "key bigint, a bigint, b bigint"))
    pairs = stars.select("a", "b").distinct()

    def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        def meet(pairs: DataFrame, *columns: str) -> DataFrame:
            for end in "ab":
                pairs = pairs.join(texts.select(F.col("h").alias(end), *[F.col(c).alias(c[0] + end) for c in columns]), end)
            return pairs

        likely = meet(pairs, "sig").mapInArrow(partial(_likely, threshold=threshold), "a bigint, b bigint")
        rows = meet(likely, "line").select("a", "b", "la", "lb").sortWithinPartitions("a", "b")
        return keep(rows.mapInArrow(partial(_verify, threshold=threshold), "a bigint, b bigint"))

    wanted = stars.select(F.explode(F.array("a", "b")).alias("h"))
    n = wanted.agg(F.approx_count_distinct("h")).first()[0]
    # a bit table of fixed size at most: 32 MB, in words of 8 bytes; it only saves work, the join decides
    size = min(1 << 25, max(1 << 10, 1 << (4 * max(n, 1)).bit_length() - 1))
    rows = wanted.select(F.expr(f"h & {size * 8 - 1}L").alias("bit")).groupBy(F.expr("cast(bit >> 6 as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(size // 8, "<i8")
    bits[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    bits = bits.view(np.uint8)
    table = spark.sparkContext.broadcast(bits)
    found = docs.mapInArrow(lambda batches: _lines_of(batches, table.value), "h bigint, line string, sig binary")
    texts = keep(found.join(wanted.distinct(), "h", "left_semi").groupBy("h").agg(*[F.first(c).alias(c) for c in ("line", "sig")]))
    good = verified(pairs, texts)
    # members of keys of three lines or more whose lines are not all in one class yet
    top = components(good).select(F.col("node").alias("b"), F.col("root").alias("rb"))
    many = stars.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    member = keep(many.join(stars.select("key", "b"), "key").join(top, "b", "left").select("key", "b", F.coalesce("rb", "b").alias("rb")))
    mixed = member.groupBy("key").agg(F.min("rb").alias("lo"), F.max("rb").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n")
    left = keep(mixed.join(member, "key"))
    part = keep(texts.join(left.select(F.col("b").alias("h")).distinct(), "h", "left_semi"))
    few = left.where(F.col("n") <= SMALL)
    rest = few.alias("p").join(few.alias("q"), F.expr("p.key = q.key and p.b < q.b and p.rb <> q.rb")).select(F.col("p.b").alias("a"), F.col("q.b").alias("b"))
    crowd = keep(left.where(F.col("n") > SMALL).select(F.col("b").alias("h"), F.col("rb").alias("top")).distinct())
    if not crowd.isEmpty():
        rest = rest.union(prefix_pairs(crowd.join(part.select("h", "line"), "h"), threshold))
    good = good.union(verified(rest.distinct().join(pairs, ["a", "b"], "left_anti"), part))
    top = components(good).toDF("h", "top")
    # only lines that are there repeatedly, or have similar ones, need another place than their own
    names = top.union(top.select("top", "top")).distinct()
    last = F.lit((1 << 63) - 1)  # of null doc_ids
    own = lines.select("doc_id", "text_hash", "line_no", "h")
    counts = own.groupBy("h").agg(F.count("*").alias("n"), F.min(F.coalesce("doc_id", last)).alias("d"))
    known = keep(counts.join(names, "h", "left").where("n > 1 or top is not null").select("h", F.coalesce("top", "h").alias("top"), "d"))
    least = known.groupBy("top").agg(F.min("d").alias("d"))
    rows = keep(own.join(known.drop("d").join(least, "top"), "h", "left"))
    several = rows.where("top is not null")
    best = several.where(F.coalesce("doc_id", last) == F.col("d")).groupBy("top").agg(F.min(F.struct(F.col("text_hash").alias("t"), F.col("line_no").alias("l"), F.col("doc_id").alias("doc"))).alias("best"))
    here = F.coalesce("doc_id", last) == F.col("d")
    kept = here & (F.col("best.t") == F.col("text_hash")) & (F.col("best.l") == F.col("line_no"))
    out = several.join(best, "top").select("doc_id", "text_hash", "line_no", F.col("best.doc").alias("first_doc_id"), F.col("best.l").alias("first_line_no"), kept.alias("kept"))
    return out.union(rows.where("top is null").select("doc_id", "text_hash", "line_no", "doc_id", "line_no", F.lit(True)))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with all their columns, without lines that repeat an earlier one; n_chars, where there is one, follows the text.

    Every document stays, be it with an empty text.
    """
    prepare(docs.sparkSession)
    drop = line_classes(docs, threshold).where("not kept").groupBy(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h")).agg(F.collect_set("line_no").alias("__drop"))
    rows = docs.withColumn("__t", F.xxhash64(F.col("text").cast("string")))
    joined = rows.join(drop, F.col("doc_id").cast("bigint").eqNullSafe(F.col("__d")) & (F.col("__t") == F.col("__h")), "left")
    lines = F.split("text", "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("__drop"), i)), "\n")
    out = joined.withColumn("text", F.when(F.col("__drop").isNull(), F.col("text")).otherwise(left))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__drop").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
