"""Near-duplicate documents by SimHash fingerprints and BK-trees.

A fingerprint has a bit for each of the 64 bits of XXH64 over the text's 3-word
shingles, set where over half of the shingles have it set. Fingerprints that differ in
at most 3 bits are linked; a document's class is what its links reach.

Equal fingerprints are one node with a count. If two nodes differ in at most 3 bits, one
of their four 16-bit quarters is equal, so the nodes are sharded by (quarter, value) and
every shard gets a BK-tree: children keyed by their Hamming distance to the parent, of
which a search follows only the edges within the radius. A shard of more than LARGE
nodes is sharded again by the same rule over the other 48 bits (four parts of 12), then
over the next 36 and 27 (parts of 9 and 7). A pair is counted only in the first shard in
which it can meet. A shard's tree returns counts and the edges of its local forest, never
pairs. Shard trees are built where the shard is, rather than broadcast, because they grow
with the data.

Defined results. Null or empty text, or one without words: fingerprint zero, linked like
any other. Under three words: one shingle, the whole sequence. Null doc_id: kept; it
can't name a class unless all of its class are null. Repeated rows: linked documents as
any others. Ties: none arise, as a class is named by its smallest doc_id. Empty table: no
rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, keep, prepare, slices, spread
from .components import components, forest

RADIUS, LARGE = 3, 4096
#: Bits of a part on each level of shards; a level has four parts.
WIDTHS = (16, 12, 9, 7)
_FP = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])
_OUT = pa.schema([("fp", pa.int64()), ("near", pa.int64()), ("root", pa.int64())])


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint of one text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxh64_intdigest(s, 42) for s in (map(b" ".join, zip(words, words[1:], words[2:])) if len(words) > 2 else [b" ".join(words)])]
    bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for b in slices(batches):
        fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
        yield batch(_FP, b.column("doc_id"), b.column("text_hash"), fp)


class BKTree:
    """Numbers under Hamming distance; ``add(x)`` returns those within the radius that were there before."""

    def __init__(self, radius: int = RADIUS):
        self.radius, self.root = radius, None

    def add(self, x: int) -> list[int]:
        if self.root is None:
            self.root = (x, {})
            return []
        near, radius, stack = [], self.radius, [self.root]
        while stack:
            value, children = stack.pop()
            d = (value ^ x).bit_count()
            if d <= radius:
                near.append(value)
            for k in range(max(d - radius, 0), d + radius + 1):
                if k in children:
                    stack.append(children[k])
        value, children = self.root
        while (d := (value ^ x).bit_count()) in children:
            value, children = children[d]
        children[d] = (x, {})
        return near


def _without(x: int, width: int, part: int) -> int:
    """The bits besides a part."""
    return x & ((1 << width * part) - 1) | x >> width * (part + 1) << width * part


def _meets_here(x: int, path: tuple[int, ...]) -> bool:
    """Whether these parts are, on each level, the first in which two fingerprints, which differ in the bits of x, are equal."""
    for width, part in zip(WIDTHS, path):
        mask = (1 << width) - 1
        for k in range(part):
            if not x >> k * width & mask:
                return False
        x = _without(x, width, part)
    return True


def _path(shard: int) -> tuple[int, ...]:
    """The parts that a shard's number names: 2 bits with the level, then 2 for each part, then the values."""
    return tuple(shard >> 50 - 2 * k & 3 for k in range((shard >> 52 & 3) + 1))


def _shard_trees(batches):
    """Rows (shard, fp, n) in the order of shard; a shard may span batches."""
    held: list[tuple[np.ndarray, ...]] = []

    def tree(path: tuple[int, ...], fps: np.ndarray, n: np.ndarray):
        values = fps.view(np.uint64).tolist()
        where = {v: i for i, v in enumerate(values)}
        near, a, b, bk = np.zeros(len(values), np.int64), [], [], BKTree()
        for i, v in enumerate(values):
            for w in bk.add(v):
                if _meets_here(v ^ w, path):
                    j = where[w]
                    near[i] += n[j]
                    near[j] += n[i]
                    a.append(i)
                    b.append(j)
        if a:
            at = np.flatnonzero(near)
            nodes, roots = forest(np.array(a), np.array(b))
            return fps[at], near[at], fps[roots[np.searchsorted(nodes, at)]]
        return None

    def close(parts):
        shard, fp, n = (np.concatenate(c) for c in zip(*parts))
        edges = np.flatnonzero(np.diff(shard)) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(shard)]])
        found = [r for s, e in zip(starts.tolist(), ends.tolist()) if e - s > 1 and (r := tree(_path(int(shard[s])), fp[s:e], n[s:e]))]
        if found:
            yield batch(_OUT, *(np.concatenate(c) for c in zip(*found)))

    for b in batches:
        if not b.num_rows:
            continue
        c = tuple(b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        last = int(np.searchsorted(c[0], c[0][-1]))  # the last shard may go on
        if last:
            yield from close([*held, tuple(x[:last] for x in c)])
            held = []
        held.append(tuple(x[last:] for x in c))
        if len(held) > 1 and held[-2][0][-1] != held[-1][0][0]:
            yield from close(held[:-1])
            held = held[-1:]
    if held:
        yield from close(held)


def near_fingerprints(nodes: DataFrame) -> DataFrame:
    """Of distinct ``fp`` with counts ``n``: fp, near (rows of other nodes linked directly), root of a forest of the links; only nodes with a link, once for each shard that found one."""
    rows = nodes.select("fp", "n", F.col("fp").alias("rest"), F.lit(0).cast("bigint").alias("shard"))
    done, used = None, 0
    for level, width in enumerate(WIDTHS):
        mask = (1 << width) - 1
        part = [
            F.struct(
                F.lit(k).alias("part"),
                F.shiftrightunsigned("rest", width * k).bitwiseAND(mask).alias("value"),
                # the bits besides the part; nothing is above the fourth of the first level
                F.col("rest").bitwiseAND((1 << width * k) - 1).bitwiseOR(F.shiftleft(F.shiftrightunsigned("rest", width * (k + 1)), width * k) if width * (k + 1) < 64 else F.lit(0).cast("bigint")).alias("others"),
            )
            for k in range(4)
        ]
        used += width
        # the number: level, parts, values
        place = F.col("shard").bitwiseAND((1 << 52) - 1).bitwiseOR(F.shiftleft(F.col("s.part").cast("bigint"), 50 - 2 * level)).bitwiseOR(F.shiftleft("s.value", 44 - used)).bitwiseOR(F.lit(level << 52))
        rows = rows.withColumn("s", F.explode(F.array(*part))).select("fp", "n", F.col("s.others").alias("rest"), place.alias("shard"))
        large = keep(rows.groupBy("shard").agg(F.count("*").alias("c")).where(F.col("c") > LARGE).select("shard")) if level < len(WIDTHS) - 1 else None
        if large is None or large.isEmpty():
            done = rows if done is None else done.union(rows)
            break
        small = rows.join(large, "shard", "left_anti").select("fp", "n", "rest", "shard")
        done = small if done is None else done.union(small)
        rows = rows.join(large, "shard", "left_semi").select("fp", "n", "rest", "shard")
    return done.select("shard", "fp", "n").repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(_shard_trees, "fp bigint, near bigint, root bigint")


def _row_key():
    return F.col("doc_id").cast("bigint"), F.xxhash64(F.col("text").cast("string"))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, fp), one of each document; nodes (fp, n_near, component_id, top), where top is the class."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(*[c.alias(n) for c, n in zip(_row_key(), ("doc_id", "text_hash"))], "text")
    rows = keep(spread(rows).mapInArrow(partial(_fingerprints), "doc_id bigint, text_hash bigint, fp bigint"))
    nodes = keep(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")))
    links = keep(near_fingerprints(nodes.select("fp", "n")))
    root = components(links.select("fp", "root"))
    near = links.groupBy("fp").agg(F.sum("near").alias("near"))
    node = nodes.join(near, "fp", "left").join(root.withColumnRenamed("node", "fp").withColumnRenamed("root", "top"), "fp", "left").select("fp", "n", "first", F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("top", "fp").alias("top"), F.col("near").isNotNull().alias("linked"))
    node = keep(node)
    # only classes of several nodes need another name than their node's own
    names = node.where("linked").groupBy("top").agg(F.min("first").alias("name"))
    node = node.join(names, "top", "left").select("fp", (F.col("near") + F.col("n") - 1).alias("n_near"), F.coalesce("name", "first").alias("component_id"), "top")
    return rows, node


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), n_near (other documents linked directly), component_id (smallest doc_id of the class)."""
    rows, node = _classes(docs)
    return rows.join(node, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each class, the one of the smallest doc_id, then the smallest text hash, with all its columns.

    Rows are told apart by doc_id and text hash: those of other classes stay, whatever
    doc_id they share. Null doc_ids come last in a class.
    """
    key, text = _row_key()
    rows, node = _classes(docs)
    each = rows.join(node.select("fp", "top"), "fp").groupBy("top", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "n")).alias("b")
    good = keep(each.groupBy("top").agg(best).select(F.col("b.doc_id").alias("__d"), F.col("b.text_hash").alias("__t"), F.col("b.n").alias("__n")))

    def of(some: DataFrame) -> DataFrame:
        return docs.join(some, key.eqNullSafe(F.col("__d")) & (text == F.col("__t")), "left_semi")

    # rows that are alike in both
    twice = good.where("__n > 1")
    if twice.isEmpty():
        return of(good)
    w = Window.partitionBy(key, text).orderBy(F.lit(0))
    one = of(twice).withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*docs.columns)
    return of(good.where("__n = 1")).unionByName(one)
