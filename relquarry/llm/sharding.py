"""Shards of nearly equal bytes that never part equal texts.

Rows of equal text form a group. Groups are ordered by a 60-bit hash of the text, and the
order is cut into contiguous runs so that the largest run is as small as it can be: a
binary search over the capacity, each candidate checked by filling shards greedily.

The driver never sees the groups. It starts from the bytes of 4,096 ranges of the hash.
Filling shards with ranges whole, and with ranges that may be cut anywhere, bounds the
capacity and the place of every cut from both sides; only the ranges in which a cut may
fall are refined, into 4,096 each, until those hold one group. So a level costs a job, and
rows that depend on the number of shards, not on the number of groups; five levels end the
hash. A row's shard then follows from its hash and the cut hashes, with no join.

Slots follow doc_id, size and crc (nulls first): a range sort whose last key is the row's
place in the input, so that no key, however hot, is one task.

Defined results. Null text: no bytes, so size 1; all null texts are one group, apart from
the empty text's. text_crc32 of a null: null. Null doc_id: kept. Repeated rows: each
takes its own slot. Empty table: no rows. Other columns are ignored. Fewer groups than
shards: the last shards stay empty. Texts whose hashes are equal stay together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_text, keep, partitions, prepare

BITS, FAN = 60, 12
#: Rows of a range that slots are counted in.
SLOT_ROWS = 1_000_000


def group_hash(text: str = "text") -> F.Column:
    """First 60 bits of the MD5; 0 for null."""
    return F.coalesce(F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, BITS // 4), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))


class _Ranges:
    """Ranges of the hash in order: the hash that each begins with, its bytes, and whether it is one group."""

    def __init__(self, start: list[int], size: list[int], one: list[bool]):
        self.start, self.size, self.one = start, np.array(size, np.int64), np.array(one, bool)
        self.end = np.concatenate([[0], np.cumsum(self.size)])

    def cuts(self, capacity: int, shards: int, whole: bool) -> list[int]:
        """Bytes before each later shard, filled greedily; the list ends where all is held. whole: ranges of several groups aren't cut, else anywhere."""
        at, out, total = 0, [], int(self.end[-1])
        while at + capacity < total and len(out) < shards:
            to = at + capacity
            k = int(np.searchsorted(self.end, to, side="right")) - 1
            at = int(self.end[k]) if whole or self.one[k] else to
            out.append(at)
        return out

    def least(self, low: int, shards: int, whole: bool) -> int:
        """Smallest capacity from low on whose greedy filling holds all."""
        high = max(low, int(self.end[-1]))
        while low < high:
            middle = (low + high) // 2
            if len(self.cuts(middle, shards, whole)) < shards:
                high = middle
            else:
                low = middle + 1
        return low


def capacity_cuts(sizes: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Smallest capacity that suffices, and the first hash of each later shard that isn't empty.

    sizes: h bigint (of BITS bits), bytes bigint, one row per group.
    """

    def children(shift: int, parents: list[int] | None):
        rows = sizes if parents is None else sizes.where(F.shiftright("h", shift + FAN).isin(parents))
        rows = rows.groupBy(F.shiftright("h", shift).alias("id")).agg(F.sum("bytes").alias("s"), F.count("*").alias("n"), F.min("h").alias("first"), F.max("bytes").alias("most"))
        return sorted(map(tuple, rows.collect()))

    shift = BITS - FAN
    found = children(shift, None)
    if not found:
        return 0, []
    largest, total = max(r[4] for r in found), sum(r[1] for r in found)
    ranges = _Ranges([r[3] for r in found], [r[1] for r in found], [r[2] == 1 for r in found])
    low, high = max(-(-total // shards), largest), total
    while True:
        high = min(high, ranges.least(max(low, int(ranges.size.max())), shards, True))
        low = ranges.least(low, shards, False)
        near: set[int] = set()
        # a cut of the true capacity is at or after that of the lower bound in whole ranges, and at or before that of the upper one in divisible ones
        first, last = ranges.cuts(low, shards, True), ranges.cuts(high, shards, False)
        first += [int(ranges.end[-1])] * (shards - len(first))
        last += [int(ranges.end[-1])] * (shards - len(last))
        for a, z in zip(first, last):
            i, j = (int(np.searchsorted(ranges.end, x, side="right")) - 1 for x in (a, z))
            near.update(k for k in range(max(0, i), min(len(ranges.one) - 1, j) + 1) if not ranges.one[k])
        if not near:
            break
        shift -= FAN
        by: dict[int, list] = {}
        for r in children(shift, sorted({ranges.start[k] >> (shift + FAN) for k in near})):
            by.setdefault(r[0] >> FAN, []).append(r)
        start, size, one = [], [], []
        for k, s in enumerate(ranges.start):
            if k in near:
                for r in by[s >> (shift + FAN)]:
                    start.append(r[3])
                    size.append(r[1])
                    one.append(r[2] == 1)
            else:
                start.append(s)
                size.append(int(ranges.size[k]))
                one.append(bool(ranges.one[k]))
        ranges = _Ranges(start, size, one)
    capacity = ranges.least(low, shards, True)
    at = np.searchsorted(ranges.end, ranges.cuts(capacity, shards, True))
    return capacity, [ranges.start[k] for k in at.tolist()]


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; a shard's slots run from 0 without a gap.

    Two passes over the texts, neither of which moves them: the first sums bytes by
    group (16 bytes a group shuffled), the second sorts rows of 40 bytes by shard, doc_id,
    size and crc, and counts them off.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"), crc_text("text").alias("text_crc32"), group_hash().alias("h")
    )
    sizes = keep(rows.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    _, cuts = capacity_cuts(sizes.select("h", "bytes"), shards)
    where = F.lit(0)
    for c in cuts:
        where = where + (F.col("h") >= F.lit(c)).cast("int")
    rows = rows.select("doc_id", "size", "text_crc32", where.alias("shard"), F.monotonically_increasing_id().alias("m"))
    n = sizes.agg(F.sum("n")).first()[0] or 0
    parts = max(1, min(n // SLOT_ROWS + 1, 1 << 16), partitions(spark) if n > SLOT_ROWS else 1)
    key = [F.col(c).asc_nulls_first() for c in ("shard", "doc_id", "size", "text_crc32", "m")]
    rows = keep(rows.repartitionByRange(parts, *key).sortWithinPartitions(*key).drop("m").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    # a few rows a partition: where each shard's rows begin in it
    starts = sorted(map(tuple, rows.groupBy("shard", "part").agg(F.count("*"), F.min("at")).collect()))
    offset, before, last = [], 0, None
    for s, p, count, at in starts:
        before = before if s == last else 0
        offset.append((s, p, before - at))
        before, last = before + count, s
    offsets = F.broadcast(spark.createDataFrame(offset, "shard int, part int, offset bigint"))
    return rows.join(offsets, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("offset")).alias("slot"))
