"""Near-duplicate vectors by a forest of random-projection trees.

A tree splits recursively: a node at level k projects on that level's random direction
and splits at its own threshold, the median of a bounded sample that reached it. Vectors
within ``spill`` of a threshold go to both sides. Vectors of one label that share a leaf
in any of the trees are compared in double precision; pairs at or above the threshold are
links, and classes are what links reach.

Equal vectors of a label are one node with a count. A pair is counted only in the first
tree in which it shares a leaf, and there in the first such leaf, so that leaves return
counts and the edges of a local forest, never pairs. A leaf of more than LEAF_ROWS nodes
of a label is compared block by block, in a task for each pair of blocks.

Defined results. A vector that is null, empty, zero, or holds null or non-finite
components, or whose label is null, links with nothing and is its own class. Vectors of
other lengths than the first's in a leaf never link with it. Null vec_id: kept, can't
name a class. Repeated rows: linked as any others. Empty table: no rows. Other columns
are ignored.
"""

from __future__ import annotations

from functools import partial
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, keep, prepare
from .components import components, forest

TREES, LEAF, SPILL, SAMPLE, LEAF_ROWS, MAX_DEPTH = 5, 256, 0.02, 20_000, 8192, 18
_ASSIGN = "leaf bigint, label int, node bigint, n bigint, vector binary, leaves binary"
_ASSIGNED = pa.schema([("leaf", pa.int64()), ("label", pa.int32()), ("node", pa.int64()), ("n", pa.int64()), ("vector", pa.binary()), ("leaves", pa.binary())])
_LINK = pa.schema([("node", pa.int64()), ("near", pa.int64()), ("root", pa.int64())])


class Forest:
    """Directions by tree and level, thresholds by tree and node (heap order)."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, spill: float = SPILL, seed: int = 8):
        dims = sample.shape[1] if len(sample) else 1
        self.depth, self.trees, self.spill = depth, trees, spill
        d = np.random.default_rng(seed).standard_normal((trees, max(depth, 1), dims))
        self.directions = d / np.linalg.norm(d, axis=2, keepdims=True)
        self.thresholds = np.zeros((trees, 1 << depth))
        for t in range(trees):
            at = np.ones(len(sample), np.int64)
            for k in range(depth):
                p = sample @ self.directions[t, k]
                order = np.lexsort((p, at))
                nodes, first, count = np.unique(at[order], return_index=True, return_counts=True)
                self.thresholds[t, nodes] = p[order[first + count // 2]]
                at = 2 * at + (p >= self.thresholds[t, at])

    def leaves(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each tree, row numbers and leaves; a row may have several."""
        out = []
        for t in range(self.trees):
            row, at = np.arange(len(x)), np.ones(len(x), np.int64)
            for k in range(self.depth):
                p = x @ self.directions[t, k]
                gap = p[row] - self.thresholds[t, at]
                left, right = gap < self.spill, gap >= -self.spill
                row, at = np.concatenate([row[left], row[right]]), np.concatenate([2 * at[left], 2 * at[right] + 1])
            out.append((row, at + (np.int64(t) << 40)))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assign(batches, forest_: Forest):
    """Rows for leaves: leaf, label, node, n, vector, the node's leaves."""
    dims = forest_.directions.shape[2]
    for b in batches:
        lengths = b.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
        for size in np.unique(lengths):
            c = b.filter(pa.array(lengths == size))
            x = _unit(_matrix(c.column("embedding")))
            proj = x[:, :dims] if size >= dims else np.pad(x, ((0, 0), (0, dims - size)))
            found = forest_.leaves(proj)
            row, leaf = np.concatenate([r for r, _ in found]), np.concatenate([f for _, f in found])
            order = np.lexsort((leaf, row))
            row, leaf = row[order], leaf[order]
            at = np.searchsorted(row, np.arange(c.num_rows + 1))
            label, node, n = (c.column(k).to_numpy(zero_copy_only=False) for k in ("label", "node", "n"))
            sets = [leaf[at[i] : at[i + 1]].tobytes() for i in range(c.num_rows)]
            data = [v.tobytes() for v in x]
            for s in range(0, len(row), 2000):
                i = row[s : s + 2000]
                yield batch(_ASSIGNED, leaf[s : s + 2000], label[i], node[i], n[i], [data[k] for k in i], [sets[k] for k in i])


def _codes(batches, forest_: Forest):
    dims = forest_.directions.shape[2]
    for b in batches:
        ok = b.filter(pa.array(b.column("embedding").value_lengths().to_numpy(zero_copy_only=False) == dims))
        x = _unit(_matrix(ok.column("embedding")))
        label = ok.column("label").to_numpy(zero_copy_only=False)
        for row, leaf in forest_.leaves(x):
            yield batch(pa.schema([("leaf", pa.int64()), ("label", pa.int32())]), leaf, label[row])


def _compare(batches, threshold: float, depth: int):
    """Complete leaves, one at a time; rows come in the order of leaf, label, block."""
    held: list[pa.RecordBatch] = []

    def close(t: pa.RecordBatch):
        leaf = t.column("leaf")[0].as_py()
        node, n, own = (t.column(k).to_numpy(zero_copy_only=False) for k in ("node", "n", "own"))
        by: dict[int, list[int]] = {}
        raw = [v.as_buffer() for v in t.column("vector")]
        for i, v in enumerate(raw):
            by.setdefault(v.size, []).append(i)
        cross = len(np.unique(own)) > 1
        near, a, b = np.zeros(len(node), np.int64), [], []
        for rows in by.values():
            rows = np.array(rows)
            x = np.stack([np.frombuffer(raw[i]) for i in rows])
            sets = [np.frombuffer(t.column("leaves")[int(i)].as_buffer(), np.int64) for i in rows]
            # leaves that come before this one, as columns
            before = [s[s < leaf] for s in sets]
            ids, inv = np.unique(np.concatenate(before), return_inverse=True)
            member = np.zeros((len(rows), max(1, len(ids))), np.float32)
            member[np.repeat(np.arange(len(rows)), [len(s) for s in before]), inv] = 1
            for i in range(0, len(rows), 1024):
                for j in range(i, len(rows), 1024):
                    s = x[i : i + 1024] @ x[j : j + 1024].T >= threshold
                    if i == j:
                        s = np.triu(s, 1)
                    p, q = np.nonzero(s)
                    if not len(p):
                        continue
                    p, q = p + i, q + j
                    new = np.einsum("ij,ij->i", member[p], member[q]) == 0 if len(p) < 4096 else (member[i : i + 1024] @ member[j : j + 1024].T)[p - i, q - j] == 0
                    # within a crowded leaf, pairs of one block are counted in that block's own task
                    new &= (own[rows[p]] != own[rows[q]]) if cross else True
                    p, q = rows[p[new]], rows[q[new]]
                    np.add.at(near, p, n[q])
                    np.add.at(near, q, n[p])
                    a.append(p)
                    b.append(q)
        if a and sum(map(len, a)):
            at = np.flatnonzero(near)
            nodes, roots = forest(np.concatenate(a), np.concatenate(b))
            return batch(_LINK, node[at], near[at], node[roots[np.searchsorted(nodes, at)]])
        return None

    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("leaf", "label", "block")])
        edges = [0, *(np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1).tolist(), b.num_rows]
        for s, e in zip(edges, edges[1:]):
            key = tuple(keys[:, s])
            if key != last and held:
                t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
                if t.num_rows > 1 and (r := close(t)) is not None:
                    yield r
            last = key
            held.append(b.slice(s, e - s))
    if held:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        if t.num_rows > 1 and (r := close(t)) is not None:
            yield r


def near_vectors(vectors: DataFrame, threshold: float = 0.93, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id, kept.

    vectors: vec_id, embedding (array of float or double), label. Cosines are in double
    precision and every link was verified. Thresholds of the trees come from SAMPLE
    vectors at most; every vector is indexed.
    """
    spark = vectors.sparkSession
    prepare(spark)
    bad = "embedding is null or label is null or size(embedding) = 0 or exists(embedding, c -> c is null or isnan(c) or abs(c) = double('infinity')) or forall(embedding, c -> c = 0)"
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("int").alias("label"))
    rows = rows.withColumn("bad", F.coalesce(F.expr(bad), F.lit(True)))
    good = rows.where("not bad")
    node = F.xxhash64("label", "embedding", F.lit(1)).alias("node")
    second = F.xxhash64(F.lit(2), "embedding", "label").alias("second")
    nodes = keep(good.select("vec_id", "embedding", "label", node, second).groupBy("node", "second", "label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.first("embedding").alias("embedding")))
    sizes = nodes.groupBy("label").agg(F.count("*").alias("c")).agg(F.max("c"), F.sum("c")).first()
    if sizes[0]:
        share = min(1.0, SAMPLE / sizes[1])
        some = nodes.where(F.pmod("node", F.lit(1 << 20)) < ceil(share * (1 << 20))).select("embedding").limit(2 * SAMPLE).toArrow().column(0)
        width = max(map(len, some)) if len(some) else 1
        sample = _unit(np.array([v for v in some.to_pylist() if len(v) == width], float).reshape(-1, width))
        depth = min(MAX_DEPTH, max(0, ceil(log2(sizes[0] / leaf))))
        made = Forest(sample, depth, trees, spill)
        codes = nodes.select("label", "embedding").mapInArrow(partial(_codes, forest_=made), "leaf bigint, label int")
        crowded = keep(codes.groupBy("leaf", "label").agg(F.count("*").alias("c")).where(F.col("c") > LEAF_ROWS).select("leaf", "label", F.ceil(F.col("c") / (LEAF_ROWS // 2)).cast("int").alias("k")))
        # equal 64-bit keys of different vectors stay apart by their place in the key
        assigned = nodes.select("node", "n", "label", "embedding").mapInArrow(partial(_assign, forest_=made), _ASSIGN)
        if crowded.isEmpty():
            assigned = assigned.withColumns({"own": F.lit(0), "block": F.lit(0)})
        else:
            assigned = assigned.join(crowded, ["leaf", "label"], "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("own", F.pmod("node", F.col("k")).cast("int"))
            assigned = assigned.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("block", F.least("own", "other") * F.col("k") + F.greatest("own", "other"))
        assigned = assigned.select("leaf", "label", "block", "node", "n", "own", "vector", "leaves")
        keys = ["leaf", "label", "block"]
        links = keep(assigned.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(partial(_compare, threshold=threshold, depth=depth), "node bigint, near bigint, root bigint"))
    else:
        links = spark.createDataFrame([], "node bigint, near bigint, root bigint")
    root = components(links.select("node", "root")).withColumnRenamed("root", "top")
    near = links.groupBy("node").agg(F.sum("near").alias("near"))
    full = keep(nodes.drop("embedding").join(near, "node", "left").join(root, "node", "left").withColumn("top", F.coalesce("top", "node")))
    names = full.groupBy("top").agg(F.min("first").alias("name"))
    full = full.join(names, "top").select("node", "second", (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("n_links"), "name")
    return (
        rows.select("vec_id", "bad", F.when(~F.col("bad"), node).alias("node"), F.when(~F.col("bad"), second).alias("second"))
        .join(full, ["node", "second"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("bad"), F.col("vec_id")).otherwise(F.col("name")).alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
