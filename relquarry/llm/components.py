"""Connected components of an edge table by distributed union-find.

Every partition first reduces its own edges to a forest with an in-memory union-find,
which keeps at most one edge per node. Forests are then merged: while they are small
(``one_task`` edges, 16 bytes each, counted first) in one task, else by alternating
large-star and small-star rounds, each of which is two shuffles and is checkpointed.
Both ways give the same labels: the smallest node id of each component.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, keep

_EDGE = pa.schema([("node", pa.int64()), ("root", pa.int64())])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node of the component of each."""
    if not len(a):
        return a, a
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    p = np.arange(len(nodes))
    while len(x):
        px, py = p[x], p[y]
        np.minimum.at(p, np.maximum(px, py), np.minimum(px, py))
        while True:
            q = p[p]
            if (q == p).all():
                break
            p = q
        open_ = p[x] != p[y]
        x, y = x[open_], y[open_]
    return nodes, nodes[p]


def _reduce(batches, flush: int = 1 << 20):
    a, b, n = [], [], 0

    def out():
        nodes, roots = forest(np.concatenate(a), np.concatenate(b))
        far = nodes != roots
        return nodes[far], roots[far]

    for r in batches:
        a.append(r.column(0).to_numpy(zero_copy_only=False))
        b.append(r.column(1).to_numpy(zero_copy_only=False))
        n += r.num_rows
        if n >= flush:
            x, y = out()
            a, b, n = [x], [y], 0
            if len(x) > flush // 2:
                yield batch(_EDGE, x, y)
                a, b = [], []
    if a:
        yield batch(_EDGE, *out())


def components(edges: DataFrame, one_task: int = 2_000_000, max_rounds: int = 60) -> DataFrame:
    """Labels of the nodes that have an edge.

    edges: two bigint columns, without nulls; loops and repeats are harmless.
    Returns ``node``, ``root`` for every node whose component has another, smaller node,
    and for no other; a node that is absent is its own root. Empty edges: no rows.
    """
    e = edges.toDF("node", "root").where("node <> root")
    e = keep(e.mapInArrow(partial(_reduce), "node bigint, root bigint"))
    if e.count() <= one_task:
        return keep(e.coalesce(1).mapInArrow(partial(_reduce, flush=1 << 62), "node bigint, root bigint"))
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select("root", "node"))
        low = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("low"))
        e = both.where("root > node").join(low, "node").select(F.col("root").alias("node"), F.col("low").alias("root"))  # large star
        down = e.select(F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root")).where("node <> root").distinct()
        low = down.groupBy("node").agg(F.min("root").alias("low"))
        e = down.join(low, "node").select(F.when(F.col("root") == F.col("low"), F.col("node")).otherwise(F.col("root")).alias("node"), F.col("low").alias("root"))  # small star
        e = keep(e.where("node <> root").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if now == seen:
            return e
        seen = now
    raise RuntimeError("components did not settle")
