"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are word sequences (runs of letters, digits and underscore,
lower-cased). They are joined on seeds, hashes of MIN_MATCH consecutive words. For each
pair that shares enough seeds, tiles are marked greedily: the longest match of words that
no tile covers yet, down to MIN_MATCH words, found by running Karp-Rabin hashes over
windows of falling length. The covered share of the item's words is its coverage, which
doesn't depend on the order of the passages; a document is contaminated where an item's
coverage reaches the threshold.

Every tile consists of seeds, so that the share of an item's words that shared seeds
cover bounds its coverage from above; pairs below the threshold need no tiling, exactly.

Benchmarks of up to MAX_SEEDS seeds (counted first) are broadcast; larger ones are joined
by a shuffle on the seed. Both give the same rows. There, tiles that cover the threshold
of n words hold a quarter as many seeds at least, k, so that an item is looked up by all
its seeds but the k - 1 that most documents have, which are the hot ones; those that are
hot still are salted. Pairs are then dropped by the bound above, on seeds alone, before
any text is fetched.

Defined results. Null or empty text, or one of fewer than MIN_MATCH words: not
contaminated, coverage 0. An item with fewer words than MIN_MATCH: its whole sequence is
its seed, and must occur in one piece. Items that are null or without words match nothing.
Ties of coverage: the smaller item_id, then more tiles. Rows of one item_id with
other texts are items of their own; equal ones are one. Null doc_id and repeated rows: each judged by
itself. Very long texts: whole. Empty tables: no rows, or none contaminated. Other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, keep, prepare, slices, spread

MIN_MATCH, THRESHOLD, MAX_SEEDS = 4, 0.5, 2_000_000
_words = re.compile(r"\w+").findall
_OUT = pa.schema([("doc_id", pa.int64()), ("contaminated", pa.bool_()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_items", pa.int64()), ("n_tiles", pa.int64())])
_BASE, _MOD = 1_000_003, (1 << 61) - 1


def words(text: str | None) -> list[str]:
    return _words((text or "").lower())


def tiles(a: list, b: list, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of greedy string tiles of two sequences, longest first."""
    free_a, free_b = bytearray(b"\x01" * len(a)), bytearray(b"\x01" * len(b))
    code: dict = {}
    x = [code.setdefault(w, len(code) + 1) for w in a]
    y = [code.setdefault(w, len(code) + 1) for w in b]
    out = []
    size = min(len(a), len(b))

    def windows(s, free, n):
        """(start, hash) of windows of n free elements, by a running hash."""
        lead, h, run = pow(_BASE, n - 1, _MOD), 0, 0
        for i, v in enumerate(s):
            if not free[i]:
                h = run = 0
                continue
            if run == n:
                h = (h - s[i - n] * lead) % _MOD
                run -= 1
            h = (h * _BASE + v) % _MOD
            run += 1
            if run == n:
                yield i - n + 1, h

    while size >= least:
        # windows of the present size; matches are extended, and a longer one than the size restarts the search there
        table = defaultdict(list)
        for i, h in windows(y, free_b, size):
            table[h].append(i)
        longest, found = 0, []
        for i, h in windows(x, free_a, size) if table else ():
            for j in table.get(h, ()):
                n = 0
                while i + n < len(x) and j + n < len(y) and free_a[i + n] and free_b[j + n] and x[i + n] == y[j + n]:
                    n += 1
                if n >= size:
                    found.append((n, i, j))
                    longest = max(longest, n)
        for n, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if all(free_a[i : i + n]) and all(free_b[j : j + n]):
                free_a[i : i + n] = free_b[j : j + n] = bytes(n)
                out.append((i, j, n))
            elif n > size:
                longest = 0  # part of it may still match at this size
        if found and longest == 0:
            continue
        # halving, then single steps: the next size is that of the longest match left
        size = _next(x, y, free_a, free_b, size - 1, least, windows)
    return out


def _next(x, y, free_a, free_b, most: int, least: int, windows) -> int:
    """Length of the longest match of free elements, at most ``most``; 0 if under ``least``. Binary search: a match has shorter ones inside."""
    def any_of(n):
        have = {h for _, h in windows(y, free_b, n)}
        return bool(have) and any(h in have for _, h in windows(x, free_a, n))

    if most < least or not any_of(least):
        return 0
    low, high = least, most
    while low < high:
        middle = (low + high + 1) // 2
        if any_of(middle):
            low = middle
        else:
            high = middle - 1
    return low


class Items:
    """Benchmark items, which are the distinct (item_id, text), by number, with their seeds."""

    def __init__(self, rows):
        rows = [(i, w) for i, t in dict.fromkeys(rows) if (w := words(t))]
        self.id = [i for i, _ in rows]
        self.words = {k: w for k, (_, w) in enumerate(rows)}
        self.vocabulary: dict[str, int] = {}
        for w in self.words.values():
            for v in w:
                self.vocabulary.setdefault(v, len(self.vocabulary))
        self.seeds: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[tuple, list[int]] = defaultdict(list)
        for i, w in self.words.items():
            ids = [self.vocabulary[v] for v in w]
            if len(w) < MIN_MATCH:
                self.short[tuple(ids)].append(i)
            for p in range(len(w) - MIN_MATCH + 1):
                self.seeds[tuple(ids[p : p + MIN_MATCH])].append((i, p))
        self.codes = np.unique(np.array([self._code(np.array(s)[:, None])[0] for s in self.seeds], np.uint64))

    @staticmethod
    def _code(columns) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def judge(self, text: str | None, threshold: float):
        """contaminated, item, coverage, number of items at the threshold, tiles of the best."""
        w = words(text)
        get = self.vocabulary.get
        ids = np.fromiter((get(v, -1) for v in w), np.int64, len(w))
        best: tuple[float, int, int] | None = None
        count = 0
        hit: dict[int, set] = defaultdict(set)
        places: dict[int, list[int]] = defaultdict(list)
        n = len(w) - MIN_MATCH + 1
        if n > 0:
            known = ids >= 0
            ok = np.flatnonzero(np.logical_and.reduce([known[k : k + n] for k in range(MIN_MATCH)]))
            if len(ok):
                code = self._code([ids[ok + k] for k in range(MIN_MATCH)])
                at = np.searchsorted(self.codes, code)
                ok = ok[self.codes[np.minimum(at, len(self.codes) - 1)] == code] if len(self.codes) else ok[:0]
                for p in ok.tolist():
                    for i, q in self.seeds.get(tuple(ids[p : p + MIN_MATCH].tolist()), ()):
                        hit[i].update(range(q, q + MIN_MATCH))
                        places[i].append(p)
        for i, covered in hit.items():
            item = self.words[i]
            if len(covered) < threshold * len(item):
                continue
            # only the words around shared seeds can be in a tile
            near = sorted({p + k for p in places[i] for k in range(MIN_MATCH)})
            seq, before = [], None
            for p in near:
                if before is not None and p != before + 1:
                    seq.append(None)
                seq.append(w[p])
                before = p
            found = tiles([object() if v is None else v for v in seq], item)
            share = sum(t[2] for t in found) / len(item)
            if share >= threshold:
                count += 1
            if best is None or (share, -self.id[i], len(found)) > (best[0], -best[1], best[2]):
                best = (share, self.id[i], len(found))
        for short, items in self.short.items() if self.short else ():
            k = len(short)
            m = len(w) - k + 1
            if m > 0 and np.logical_and.reduce([ids[j : j + m] == v for j, v in enumerate(short)]).any():
                count += len(items)
                least = min(self.id[i] for i in items)
                if best is None or best[0] < 1 or least < best[1]:
                    best = (1.0, least, 1)
        if best is None:
            return False, None, 0.0, 0, 0
        return best[0] >= threshold, best[1], best[0], count, best[2]


_built: dict[tuple, Items] = {}


def _items(rows: tuple) -> Items:
    items = _built.get(rows)
    if items is None:
        _built.clear()
        items = _built[rows] = Items(rows)
    return items


def _small(benchmark: DataFrame, max_seeds: int) -> tuple | None:
    """The benchmark's rows, if it has so few seeds that it may be broadcast."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0  # at most one seed for two characters
    return None if size // 2 > max_seeds else tuple(sorted(map(tuple, items.collect())))


def _judge(batches, rows, threshold: float):
    items = _items(rows.value)
    for b in slices(batches):
        found = [items.judge(t, threshold) for t in b.column("text").to_pylist()]
        yield batch(_OUT, b.column("doc_id"), *zip(*found)) if found else batch(_OUT, *[[]] * 6)


#: Bits of the table of item seeds that documents' seeds are held against, and documents of a seed that one task joins.
BITS, HOT = 1 << 27, 50_000
_SEEDS = pa.schema([("n", pa.int32()), ("seeds", pa.list_(pa.int64()))])


def _seed_hashes(w: list[str], n: int) -> list[int]:
    """Signed hashes of all runs of n words; equal hashes of unequal runs only cost a judgement."""
    from xxhash import xxh64_intdigest

    return [h - (1 << 64) if h >> 63 else h for h in (xxh64_intdigest(" ".join(w[p : p + n])) for p in range(len(w) - n + 1))]


def _with_seeds(df: DataFrame, *columns: str, lengths: list[int] | None = None, known=None) -> DataFrame:
    """The columns, with n (number of words) and seeds, found by the very words() of the judge.

    An item has the seed at each of its places. With lengths, those of a document are
    distinct, and only ones that the table ``known`` may hold.
    """

    def find(batches):
        for b in slices(batches):
            n, seeds = [], []
            for t in b.column("text").to_pylist():
                w = words(t)
                n.append(len(w))
                if lengths is None:
                    seeds.append(_seed_hashes(w, min(MIN_MATCH, len(w))) if w else [])
                    continue
                own = np.unique(np.array([h for k in lengths for h in _seed_hashes(w, k)], np.int64))
                at = own.view(np.uint64) & np.uint64(BITS - 1)
                seeds.append(own[known.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0])
            made = batch(_SEEDS, n, seeds)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *made.columns], names=[*columns, *_SEEDS.names])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)
    return df.select(*dict.fromkeys([*columns, "text"])).mapInArrow(find, f"{kinds}, n int, seeds array<bigint>")


def _digest():
    return F.sha2(F.col("text").cast("string"), 256)


def _bit_table(seeds: DataFrame):
    """Broadcast bits of the seeds, in words of 8 bytes: 16 MB however many there are."""
    rows = seeds.select(F.expr(f"seed & {BITS - 1}L").alias("bit")).groupBy(F.expr("cast(bit >> 6 as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(BITS // 64, "<i8")
    bits[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return seeds.sparkSession.sparkContext.broadcast(bits.view(np.uint8))


def _covered(batches, threshold: float):
    """Pairs of which shared seeds cover the threshold of the item."""
    for b in batches:
        ok = []
        for n, own, seeds in zip(b.column("n").to_pylist(), b.column("own"), b.column("seeds")):
            at = np.flatnonzero(np.isin(own.values.to_numpy(), seeds.values.to_numpy()))
            covered = np.zeros(n + MIN_MATCH, bool)
            for k in range(min(MIN_MATCH, n)):
                covered[at + k] = True
            ok.append(int(covered.sum()) >= threshold * n)
        yield b.select(["row", "item_id", "k"]).filter(pa.array(ok, pa.bool_()))


def _candidates(rows: DataFrame, item: DataFrame, threshold: float) -> DataFrame:
    """row, item_id, k of texts and items of which shared seeds cover the threshold."""
    item_seeds = keep(_with_seeds(item, "item_id", "k").where("n > 0"))
    placed = item_seeds.select("item_id", "k", "n", F.explode("seeds").alias("seed"))
    # an item of fewer words than a match has its whole sequence as its seed; at most MIN_MATCH - 1 lengths
    short = [r[0] for r in item_seeds.where(f"n < {MIN_MATCH}").select("n").distinct().collect()]
    of_doc = keep(_with_seeds(rows, "row", lengths=[MIN_MATCH, *short], known=_bit_table(placed)).where("size(seeds) > 0").select("row", "seeds"))
    each = of_doc.select("row", F.explode("seeds").alias("seed"))
    df = each.join(placed.select("seed").distinct(), "seed", "left_semi").groupBy("seed").agg(F.count("*").alias("df"))
    placed = placed.join(df, "seed", "left")
    common = F.row_number().over(Window.partitionBy("item_id", "k").orderBy(F.col("df").desc_nulls_last(), "seed"))
    needed = F.when(F.col("n") < MIN_MATCH, 1).otherwise(F.greatest(F.lit(1), F.ceil(threshold * F.col("n") / MIN_MATCH - 1e-9)))
    asked = placed.withColumn("common", common).where(F.col("df").isNotNull() & (F.col("common") >= needed)).select("seed", "item_id", "k", F.ceil(F.col("df") / HOT).cast("int").alias("parts")).distinct()
    parts = keep(asked.select("seed", "parts").distinct())
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    each = each.join(parts, "seed").select("row", "seed", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"))
    pairs = each.join(asked, ["seed", "part"]).select("row", "item_id", "k").distinct()
    full = pairs.join(of_doc, "row").join(item_seeds.select("item_id", "k", "n", F.col("seeds").alias("own")), ["item_id", "k"])
    return full.select("row", "item_id", "k", "n", "own", "seeds").mapInArrow(lambda batches: _covered(batches, threshold), "row string, item_id bigint, k bigint")


def _joined(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """row, and the judgement, of every distinct text where the benchmark is too large to broadcast: texts meet their items by a shuffle on the seed.

    A judgement depends on the text alone, so that a text's digest stands for its rows; a
    number of the row would change where Spark computes the documents again.
    """
    rows = docs.where("text is not null").groupBy(_digest().alias("row")).agg(F.first("text").alias("text"))
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null")
    item = items.where("text is not null").select("item_id", "text", F.xxhash64("text").alias("k")).distinct()
    pairs = keep(_candidates(rows, item, threshold))
    full = rows.join(pairs.join(item.withColumnRenamed("text", "item_text"), ["item_id", "k"]), "row", "left")

    def judge(batches):
        for b in slices(batches):
            out = [Items([(i, t)]).judge(text, threshold) if i is not None else (False, None, 0.0, 0, 0) for text, i, t in zip(*(b.column(c).to_pylist() for c in ("text", "item_id", "item_text")))]
            found = batch(_OUT, [None] * b.num_rows, *zip(*out)).columns[1:]
            yield pa.RecordBatch.from_arrays([b.column("row"), *found], names=["row", *_OUT.names[1:]])

    each = full.mapInArrow(judge, "row string, contaminated boolean, item_id bigint, coverage double, n_items bigint, n_tiles bigint")
    best = F.max(F.struct("coverage", (-F.col("item_id")).alias("i"), "contaminated", "n_tiles", "item_id")).alias("b")
    return each.groupBy("row").agg(best, F.sum("n_items").alias("n_items")).select("row", "b.contaminated", "b.item_id", "b.coverage", "n_items", "b.n_tiles")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """doc_id, contaminated, item_id and coverage of the best item, n_items at the threshold, n_tiles of the best, of every document."""
    spark = docs.sparkSession
    prepare(spark)
    docs = spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    rows = _small(benchmark, max_seeds)
    if rows is None:
        found = docs.select("doc_id", _digest().alias("row")).join(_joined(docs, benchmark, threshold), "row", "left")
        none = {"contaminated": False, "coverage": 0.0, "n_items": 0, "n_tiles": 0}  # null texts
        return found.select(*[F.coalesce(c, F.lit(none[c])).alias(c) if c in none else c for c in _OUT.names])
    rows = spark.sparkContext.broadcast(rows)
    return docs.mapInArrow(lambda batches: _judge(batches, rows, threshold), "doc_id bigint, contaminated boolean, item_id bigint, coverage double, n_items bigint, n_tiles bigint")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    spark = docs.sparkSession
    prepare(spark)
    docs, items = spread(docs), _small(benchmark, max_seeds)
    if items is None:
        bad = _joined(docs, benchmark, threshold).where("contaminated").select(F.col("row").alias("__row"))
        return docs.join(bad, _digest() == F.col("__row"), "left_anti")
    items = spark.sparkContext.broadcast(items)

    def clean(batches):
        found = _items(items.value)
        for b in slices(batches):
            yield b.filter(pa.array([not found.judge(t, threshold)[0] for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
