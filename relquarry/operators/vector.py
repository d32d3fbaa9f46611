"""Exact and clustered vector search, and recall."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..storage import prepare

SAMPLE, MOST_CLUSTERS = 50_000, 16_384
#: Vectors, and queries, whose similarities a Python worker holds at once.
ROWS, COLUMNS = 2048, 512


def best_chunks(scored: DataFrame) -> DataFrame:
    """A document's best chunk stands for it."""
    return scored.groupBy("doc_id").agg(F.max("score").alias("score"))


def threshold(scored: DataFrame, least: float | None, kind: str) -> DataFrame:
    """Keep scores at or above a similarity threshold: (s + 1) / 2 for dot and cosine, the squared distance at or below it for Euclidean."""
    if least is None:
        return scored
    return scored.where(-F.col("score") <= least if kind == "Euclidean" else (F.col("score") + 1) / 2 >= least)


def exact(vectors: DataFrame, query, kind: str = "Dot", least: float | None = None) -> DataFrame:
    """doc_id, score of every document (rows: doc_id, vector, and scale where the vector is int8 codes; one per chunk)."""
    prepare(vectors.sparkSession)
    score = V.similarity_to_i8(query, kind)("vector", "scale") if "scale" in vectors.columns else V.similarity_to(query, kind)("vector")
    scored = vectors.select("doc_id", score.alias("score"))
    return threshold(best_chunks(scored), least, kind)


def kmedoids(x: np.ndarray, k: int, kind: str = "Dot", rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Row numbers of k medoids of a sample: assignment by similarity, then the member nearest the mean, until nothing moves."""
    rng = np.random.default_rng(seed)
    medoids = np.sort(rng.choice(len(x), min(k, len(x)), replace=False))
    sim = (lambda a, b: -((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1))) if kind == "Euclidean" else (lambda a, b: a @ b.T)
    for _ in range(rounds):
        own = sim(x, x[medoids]).argmax(axis=1)
        new = medoids.copy()
        for c in range(len(medoids)):
            at = np.flatnonzero(own == c)
            if len(at):
                new[c] = at[sim(x[at], x[at].mean(axis=0, keepdims=True))[:, 0].argmax()]
        if (new == medoids).all():
            break
        medoids = new
    return np.unique(medoids)


def fit_medoids(vectors: DataFrame, clusters: int | str = "Auto", kind: str = "Dot") -> np.ndarray:
    """Medoids fitted on SAMPLE vectors at most; Auto: two times the root of the number of vectors, MOST_CLUSTERS at most, so that the medoids fit the driver and a sample has some vectors for each. No clusters under 100 vectors."""
    n = vectors.count()
    if n < 100:
        return np.zeros((0, 0))
    k = min(MOST_CLUSTERS, max(1, int(2 * math.sqrt(n)))) if clusters == "Auto" else int(clusters)
    share = min(1.0, SAMPLE / n)
    some = vectors.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).orderBy("doc_id").select("vector").toPandas()
    x = np.stack(some["vector"].to_numpy()).astype(np.float64)
    return x[kmedoids(x, k, kind)]


def assign(vectors: DataFrame, medoids: np.ndarray, kind: str = "Dot") -> DataFrame:
    """Vectors with their cluster_id. Medoids are broadcast in the closure: about 2 * sqrt(n) vectors."""

    @F.pandas_udf("int")
    def nearest(s: pd.Series) -> pd.Series:
        best, size = [np.zeros(0, np.int64)], (medoids**2).sum(1)
        for at in range(0, len(s), ROWS):
            sim = np.stack(s.iloc[at : at + ROWS].to_numpy()).astype(np.float64) @ medoids.T
            best.append((2 * sim - size if kind == "Euclidean" else sim).argmax(axis=1))
        return pd.Series(np.concatenate(best))

    return vectors.withColumn("cluster_id", nearest("vector") if len(medoids) else F.lit(0))


def probe(query, medoids: np.ndarray, nprobe: int | None = None, least: float | None = None, kind: str = "Dot") -> list[int]:
    """Clusters to search: the nprobe most similar, of those at the threshold."""
    q = np.asarray(query, float)
    if not len(medoids):
        return [0]
    s = -((medoids - q) ** 2).sum(1) if kind == "Euclidean" else medoids @ q
    order = np.lexsort((np.arange(len(s)), -s))
    if least is not None:
        ok = (-s <= least) if kind == "Euclidean" else ((s + 1) / 2 >= least)
        order = [c for c in order if ok[c]]
    return [int(c) for c in (order if nprobe is None else order[:nprobe])]


def fit_nprobe(clustered: DataFrame, medoids: np.ndarray, kind: str = "Dot", target: float = 0.97, k: int = 10, queries: int = 200) -> int:
    """Clusters to probe so that ``target`` of the true k nearest of a bounded sample of queries, at most ``queries`` vectors chosen by a hash, lie in them."""
    if not len(medoids):
        return 1
    some = clustered.orderBy(F.xxhash64("doc_id"), "doc_id").limit(queries).select(F.col("doc_id").alias("query_id"), F.col("vector").alias("query"))
    truth = search_many(clustered.select("doc_id", "vector"), some, k, kind)
    where = truth.select("query_id", "doc_id").join(clustered.select("doc_id", "cluster_id"), "doc_id").join(some, "query_id").select("query", "cluster_id").collect()
    places = sorted(probe(q, medoids, None, None, kind).index(c) + 1 for q, c in where)
    return places[min(len(places) - 1, math.ceil(target * len(places)) - 1)] if places else 1


def search(clustered: DataFrame, query, medoids: np.ndarray, mode: str = "All", nprobe: int = 16, least: float | None = None, kind: str = "Dot") -> DataFrame:
    """mode: All, Nprobe, Similaritythreshold or NprobeSimilaritythreshold. Clusters are chosen on the driver, so that the scan prunes them."""
    rows = clustered
    if mode != "All":
        chosen = probe(query, medoids, nprobe if "Nprobe" in mode else None, least if "threshold" in mode else None, kind)
        rows = clustered.where(F.col("cluster_id").isin(chosen))
    return exact(rows, query, kind, least)


def _keep(s: np.ndarray, doc: np.ndarray, top: np.ndarray, docs: np.ndarray) -> None:
    """Take scores (a row a vector of a document, a column a query) into each query's best documents, by score rounded to 6 places, then doc_id."""
    k, slack = top.shape[1], 2e-6  # less than this below the last place may still round to it
    least = top[:, -1] - slack
    if len(s) > k and len(np.unique(doc)) == len(doc):
        free = np.flatnonzero(least == -np.inf)
        if len(free):
            least[free] = np.partition(s[:, free], len(s) - k, axis=0)[len(s) - k] - slack
    row, col = np.nonzero((s >= least) & (s > -np.inf))
    if not len(row):
        return
    hit = np.unique(col)
    old, place = np.nonzero(top[hit] > -np.inf)
    col = np.concatenate([col, hit[old]])
    score, d = np.concatenate([s[row, col[: len(row)]], top[hit[old], place]]), np.concatenate([doc[row], docs[hit[old], place]])
    order = np.lexsort((-score, d, col))  # a document's best vector
    order = order[np.append(True, (col[order][1:] != col[order][:-1]) | (d[order][1:] != d[order][:-1]))]
    order = order[np.lexsort((d[order], -np.round(score[order], 6), col[order]))]
    col = col[order]
    at = np.arange(len(col)) - np.searchsorted(col, col)
    col, order, at = col[at < k], order[at < k], at[at < k]
    top[hit], docs[hit] = -np.inf, 0
    top[col, at], docs[col, at] = score[order], d[order]


def search_many(vectors: DataFrame, queries: DataFrame, k: int = 10, kind: str = "Dot", medoids: np.ndarray | None = None, nprobe: int = 16) -> DataFrame:
    """query_id, doc_id, score, rank of the k best for each of a stated, bounded set of queries (query_id, query).

    With medoids (and a cluster_id column) a query sees the vectors of its nprobe clusters only.

    The queries are one matrix in each task, which goes over blocks of vectors and queries
    and keeps the k best documents of a query; those alone are shuffled, once a task.
    """
    prepare(vectors.sparkSession)
    q = queries.orderBy("query_id").toPandas()
    ids, m = q["query_id"].to_numpy(), np.stack(q["query"].to_numpy()).astype(np.float64) if len(q) else np.zeros((0, 1))

    probed = None
    if medoids is not None and len(medoids):
        probed = np.zeros((len(ids), len(medoids)), bool)
        for j in range(len(ids)):
            probed[j, probe(m[j], medoids, nprobe, None, kind)] = True

    def best(batches):
        # by query, its best so far: score, document; -inf where there are fewer
        top, docs = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        for b in batches:
            for at in range(0, b.num_rows if len(ids) else 0, ROWS):
                part = b.slice(at, ROWS)
                x = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                doc = part.column("doc_id").to_numpy(zero_copy_only=False)
                cluster = part.column("cluster_id").to_numpy(zero_copy_only=False) if probed is not None else None
                for j in range(0, len(ids), COLUMNS):
                    s = x @ m[j : j + COLUMNS].T
                    if kind == "Euclidean":
                        s = 2 * s - (x * x).sum(1)[:, None] - (m[j : j + COLUMNS] ** 2).sum(1)
                    if cluster is not None:
                        s[~probed[j : j + COLUMNS, cluster].T] = -np.inf
                    _keep(s, doc, top[j : j + COLUMNS], docs[j : j + COLUMNS])
        for j in range(0, len(ids), 4096):
            row, place = np.nonzero(top[j : j + 4096] > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[j + row], pa.int64()), pa.array(docs[j + row, place]), pa.array(top[j + row, place])], names=["query_id", "doc_id", "score"])

    columns = ["doc_id", "vector"] + (["cluster_id"] if probed is not None else [])
    rows = vectors.select(*columns).mapInArrow(best, "query_id bigint, doc_id bigint, score double")
    rows = rows.groupBy("query_id", "doc_id").agg(F.round(F.max("score"), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall(found: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """Share of the true k nearest that were found, over (query_id, doc_id) rows."""
    hit = truth.join(found.select("query_id", "doc_id").withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    return hit.agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))


def reciprocal_rank_fusion(lexical: DataFrame, vector: DataFrame, k: float = 0.6) -> DataFrame:
    """doc_id, score: the sum of 1 / (k + zero-based rank) over two ranked, limited lists (doc_id, score)."""
    ranked = lambda d: d.select("doc_id", (1 / (F.lit(k) + F.row_number().over(Window.orderBy(F.col("score").desc(), "doc_id")) - 1)).alias("part"))
    return ranked(lexical).union(ranked(vector)).groupBy("doc_id").agg(F.sum("part").alias("score"))
