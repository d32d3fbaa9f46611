"""An index: a folder of Parquet relations, and the state that says which of them count.

Documents come in levels, which never change once committed: ``docs`` (stored fields,
facets, geography), ``postings`` (bucketed by a hash of the term and sorted by it, so that
a query reads its terms' buckets only), ``terms`` (document frequencies), ``vectors``,
``dictionary`` and ``completions``. Vectors lie in folders of their cluster, whose medoids
were fitted when the level was written, so that a search reads the clusters that it
probes only. Levels that aren't committed are seen by real-time searches only. Deletes
are a table of ids; statistics keep counting deleted documents until ``compact``.

The state file names the levels that count and is replaced in one move, after a level's
files are whole; files that it doesn't name are left over from a failure, or superseded.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import analysis, highlight
from .functions import vectors as V
from .operators import build, facets, lexical, rewrite, vector
from .plans import query as Q
from .schema import NUMERIC, IndexMeta, Schema, meta_from_json, meta_to_json
from .storage import prepare

FORMAT = 2
#: Deleted ids that are broadcast.
BROADCAST_IDS = 4_000_000


@dataclass
class Result:
    """What a search gives: lazy DataFrames, and counts where they were asked for."""

    results: DataFrame | None = None
    result_count: int = 0
    result_count_total: int = 0
    facets: dict[str, DataFrame] = field(default_factory=dict)
    query: str = ""
    query_terms: list[str] = field(default_factory=list)
    suggestions: list[str] = field(default_factory=list)


class Index:
    def __init__(self, spark: SparkSession, path: str, schema: Schema, meta: IndexMeta, state: dict):
        prepare(spark)
        self.spark, self.path, self.schema, self.meta, self.state = spark, path.rstrip("/"), schema, meta, state
        self.embedder = None

    # -- lifecycle

    @staticmethod
    def _files(path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: Schema, meta: IndexMeta | None = None, synonyms=(), buckets: int = 16) -> Index:
        self = cls(spark, path, schema, meta or IndexMeta(), {"format": FORMAT, "next_doc": 0, "next_level": 0, "levels": [], "buckets": buckets, "deleted": 0, "synonyms": [list(p) for p in synonyms]})
        self._save()
        return self

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        where, at = cls._files(path.rstrip("/"))
        with where.open_input_file(f"{at}/index.json") as f:
            d = json.loads(f.read())
        if d["state"]["format"] != FORMAT:
            raise ValueError(f"index format {d['state']['format']}; this reads {FORMAT}")
        return cls(spark, path, Schema.from_json(d["schema"]), meta_from_json(d["meta"]), d["state"])

    def _save(self) -> None:
        where, at = self._files(self.path)
        where.create_dir(at, recursive=True)
        with where.open_output_stream(f"{at}/.index.json") as f:
            f.write(json.dumps({"schema": self.schema.to_json(), "meta": meta_to_json(self.meta), "state": self.state}).encode())
        where.move(f"{at}/.index.json", f"{at}/index.json")

    def close(self) -> None:
        self.commit()

    def clear(self) -> None:
        """Drop all documents; schema, settings and synonyms stay."""
        self.drop()
        self.state |= {"next_doc": 0, "next_level": 0, "levels": [], "deleted": 0}
        self._save()

    def drop(self) -> None:
        where, at = self._files(self.path)
        if where.get_file_info(at).type != fs.FileType.NotFound:
            where.delete_dir(at)

    # -- relations

    def _levels(self, realtime: bool = False) -> list[dict]:
        return [x for x in self.state["levels"] if x["committed"] or realtime]

    def relation(self, name: str, realtime: bool = False) -> DataFrame | None:
        paths = [f"{self.path}/{name}/level={x['id']}" for x in self._levels(realtime) if name in x["relations"]]
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*paths) if paths else None

    def deleted(self) -> DataFrame | None:
        return self.spark.read.parquet(self._deletes()) if self.state["deleted"] else None

    def _deletes(self) -> str:
        return f"{self.path}/deleted-{self.state.get('deletes', 0)}"

    def _alive(self, df: DataFrame) -> DataFrame:
        gone = self.deleted()
        if gone is None:
            return df
        # up to so many ids, 16 bytes each, documents needn't be shuffled by theirs
        return df.join(F.broadcast(gone) if self.state["deleted"] <= BROADCAST_IDS else gone, "doc_id", "left_anti")

    def documents(self, realtime: bool = False, include_deleted: bool = False) -> DataFrame:
        docs = self.relation("docs", realtime)
        if docs is None:
            return self.spark.createDataFrame([], self.schema.struct().add("doc_id", T.LongType())).select("doc_id", *[f.field for f in self.schema.fields])
        docs = docs.drop("level")
        return docs if include_deleted else self._alive(docs)

    # -- ingest

    def synonyms(self) -> DataFrame | None:
        pairs = self.state["synonyms"]
        return self.spark.createDataFrame([tuple(p) for p in pairs], "term string, synonym string") if pairs else None

    def set_synonyms(self, groups, multiway: bool = True) -> None:
        """For documents indexed from now on."""
        self.state["synonyms"] = [list(p) for p in build.synonym_pairs(groups, multiway)]
        self._save()

    def add_synonyms(self, groups, multiway: bool = True) -> None:
        have = {tuple(p) for p in self.state["synonyms"]} | set(build.synonym_pairs(groups, multiway))
        self.state["synonyms"] = [list(p) for p in sorted(have)]
        self._save()

    def index_documents(self, docs: DataFrame, id_column: str | None = None, batch: str | None = None) -> int:
        """Append documents as a level that isn't committed yet; returns their number.

        Ids go on from the last one, without a gap, unless id_column names a column of new
        ids. A batch name that was used before replaces its level.
        """
        spark, s = self.spark, self.state
        if batch and (old := next((x for x in s["levels"] if x.get("batch") == batch), None)):
            if old is s["levels"][-1]:
                s["next_doc"] = old["first"]
            s["levels"].remove(old)
        else:
            old = None
        level, first = s["next_level"], s["next_doc"]
        s["next_level"] += 1
        names = docs.columns
        columns = [F.col(f"`{f.field}`").cast(f.spark_type).alias(f.field) if f.field in names else F.lit(None).cast(f.spark_type).alias(f.field) for f in self.schema.fields]
        out = f"{self.path}/docs/level={level}"
        codec = {"none": "uncompressed"}.get(self.meta.document_compression.lower(), self.meta.document_compression.lower())
        if id_column:
            docs.select(F.col(id_column).cast("bigint").alias("doc_id"), *columns).write.option("compression", codec).mode("overwrite").parquet(out)
        else:
            staged = f"{self.path}/staging/{level}"
            docs.select(F.monotonically_increasing_id().alias("__m"), *columns).write.mode("overwrite").parquet(staged)
            rows = spark.read.parquet(staged)
            parts = sorted(map(tuple, rows.groupBy(F.shiftright("__m", 33).alias("p")).agg(F.count("*"), F.min("__m")).collect()))
            base, at = [], first
            for p, n, low in parts:
                base.append((p, at - low))
                at += n
            offsets = F.broadcast(spark.createDataFrame(base, "__p bigint, __o bigint"))  # a row a partition
            rows = rows.join(offsets, F.shiftright("__m", 33) == F.col("__p")).select((F.col("__m") + F.col("__o")).alias("doc_id"), *[f.field for f in self.schema.fields])
            rows.write.option("compression", codec).mode("overwrite").parquet(out)
            where, root = self._files(self.path)
            where.delete_dir(f"{root}/staging")
        docs = spark.read.parquet(out)
        n, last = docs.agg(F.count("*"), F.max("doc_id")).first()
        relations, length = ["docs"], 0
        if self.schema.lexical and n:
            length = self._write_lexical(docs, level, relations)
        if self.schema.vectors and n:
            self._write_vectors(docs, level)
            relations.append("vectors")
        s["levels"].append({"id": level, "first": first, "docs": n, "length": int(length), "committed": False, "relations": relations, "batch": batch})
        s["next_doc"] = max(first, (last if last is not None else -1) + 1) if id_column else first + n
        if self.meta.auto_commit_docs and sum(x["docs"] for x in s["levels"] if not x["committed"]) >= self.meta.auto_commit_docs:
            self.commit()
        else:
            self._save()
        if old:
            self._remove([old])
        return n

    def _write_lexical(self, docs: DataFrame, level: int, relations: list[str]) -> int:
        """Postings, terms and dictionary of a level, from tokens that are made once; returns the sum of lengths."""
        spark, fields = self.spark, self.schema.lexical
        cores = spark.sparkContext.defaultParallelism
        if docs.rdd.getNumPartitions() < cores:  # a small level in few files
            docs = docs.repartition(cores)
        staged = f"{self.path}/tokens/level={level}"
        where, root = self._files(self.path)
        length = self._write_postings(docs, level, staged)
        if length:
            # one shuffle, in which a bucket's terms go to many tasks
            terms = spark.read.parquet(staged).where(F.col("term").isNotNull()).groupBy("bucket", "term").agg(F.sum("df").alias("df"))
            terms.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/terms/level={level}")
            relations += ["postings", "terms"]
            words = self._dictionary_fields()
            if words is not None and len(words) < len(fields):
                rows = self._read_postings(level).where(F.col("field_id").isin(words) & ~F.col("term").contains(" "))
                build.dictionary(rows, len(words)).write.mode("overwrite").parquet(f"{self.path}/dictionary/level={level}")
                relations.append("dictionary")
        where.delete_dir(f"{root}/tokens")
        return length

    def _dictionary_fields(self) -> list[int] | None:
        """Lexical fields whose words are the dictionary's; None: no dictionary."""
        words = [i for i, f in enumerate(self.schema.lexical) if f.dictionary_source]
        return words or (list(range(len(self.schema.lexical))) if self.meta.spelling_correction else None)

    def _completion_fields(self) -> list[int] | None:
        sources = [i for i, f in enumerate(self.schema.lexical) if f.completion_source]
        return sources or (list(range(len(self.schema.lexical))) if self.meta.query_completion else None)

    def _write_completions(self) -> None:
        """Completions of the levels that have none yet: they are made when they are first asked for, and stay."""
        sources, fresh = self._completion_fields(), False
        for x in self._levels(True):
            if sources and "postings" in x["relations"] and "completions" not in x["relations"]:
                docs = self.spark.read.parquet(f"{self.path}/docs/level={x['id']}")
                rows = build.field_rows(docs, self.schema, self.meta, sources)
                build.completions(rows, sources, x["length"]).write.option("compression", "zstd").mode("overwrite").parquet(f"{self.path}/completions/level={x['id']}")
                x["relations"].append("completions")
                fresh = True
        if fresh:
            self._save()

    def index_document(self, doc: dict) -> int:
        """One document; returns its id."""
        first = self.state["next_doc"]
        self.index_documents(self.spark.createDataFrame([tuple(doc.get(f.field) for f in self.schema.fields)], self.schema.struct()))
        return first

    def _write_postings(self, docs: DataFrame, level: int, staged: str) -> int:
        """Postings of a level, and in a staging folder its terms; returns the sum of lengths."""
        where, root = self._files(self.path)
        at = f"{root}/postings/level={level}"
        if where.get_file_info(at).type != fs.FileType.NotFound:
            where.delete_dir(at)
        path = f"{self.path if ':/' in self.path else f'file://{self.path}'}/postings/level={level}"
        rows = build.field_rows(docs, self.schema, self.meta)
        build.write_postings(rows, path, self.meta, [tuple(p) for p in self.state["synonyms"]], self.state["buckets"], len(self.schema.lexical)).write.mode("overwrite").parquet(staged)
        told = self.spark.read.parquet(staged)
        length = told.agg(F.sum("length")).first()[0] or 0
        if length:
            files = {f"{at}/{r[0]}" for r in told.where(F.col("file").isNotNull()).select("file").collect()}
            for x in where.get_file_info(fs.FileSelector(at, recursive=True)):
                if x.is_file and x.base_name.endswith(".parquet") and f"{at}/{'/'.join(x.path.split('/')[-2:])}" not in files:
                    where.delete_file(x.path)
        return length

    def _read_postings(self, level: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings/level={level}")

    def _write_vectors(self, docs: DataFrame, level: int) -> None:
        parts = None
        for i, f in enumerate(self.schema.vectors):
            c = F.col(f"`{f.field}`")
            if f.field_type == "Text":  # chunks of the text, through the embedder
                if self.embedder is None:
                    raise ValueError(f"{f.field}: texts need an embedder")
                one = docs.where(c.isNotNull()).select("doc_id", F.lit(i).alias("field_id"), F.explode(analysis.chunk_text_of(self.meta.chunk_size)(c)).alias("chunk"))
                one = one.select("doc_id", "field_id", self._embed("chunk").alias("vector"))
            else:
                v = V.external_vector(c) if f.field_type == "Binary" else V.json_vector(c)
                one = docs.where(c.isNotNull()).select("doc_id", F.lit(i).alias("field_id"), v.alias("vector"))
            parts = one if parts is None else parts.union(one)
        kind = self.meta.vector_similarity
        if kind == "Cosine":
            parts = parts.withColumn("vector", V.normalize(F.col("vector")).cast("array<float>"))
        out, staged = f"{self.path}/vectors/level={level}", f"{self.path}/vectors-staged/level={level}"
        parts.write.mode("overwrite").parquet(staged)
        parts = self.spark.read.parquet(staged)
        medoids = vector.fit_medoids(parts, self.meta.clustering, kind)
        parts = vector.assign(parts, medoids, kind)
        where, root = self._files(self.path)
        where.create_dir(f"{root}/medoids", recursive=True)
        with where.open_output_stream(f"{root}/medoids/{level}.json") as f:
            f.write(json.dumps({"medoids": medoids.tolist(), "nprobe": vector.fit_nprobe(parts, medoids, kind)}).encode())
        if self.meta.quantization == "I8":
            parts = parts.withColumn("q", V.quantize_symmetric(F.col("vector"))).select("doc_id", "field_id", F.col("q.values").alias("vector"), F.col("q.scale").alias("scale"), "cluster_id")
        elif self.meta.quantization == "RotatedI8":
            parts = parts.withColumn("q", V.quantize_rotated()("vector")).select("doc_id", "field_id", F.col("q.values").alias("vector"), F.col("q.scale").alias("scale"), "cluster_id")
        salt = max(1, min(64, parts.count() // 1_000_000 // max(1, len(medoids))))
        n = max(1, min(len(medoids) * salt, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        parts = parts.repartition(n, "cluster_id", F.pmod(F.xxhash64("doc_id"), F.lit(salt))).sortWithinPartitions("cluster_id", "doc_id")
        parts.write.mode("overwrite").partitionBy("cluster_id").parquet(out)
        where.delete_dir(f"{root}/vectors-staged")

    def _embed(self, column: str):
        """Arrow UDF of the index's embedder, a function of a list of texts to a matrix."""
        embed = self.embedder

        @F.pandas_udf("array<float>")
        def of(s):
            import pandas as pd

            return pd.Series([[float(x) for x in v] for v in embed(s.tolist())], index=s.index)

        return of(column)

    def set_embedder(self, embed) -> None:
        """How texts of vector fields, and query texts, become vectors: a function that Python workers can load. It isn't stored with the index."""
        self.embedder = embed

    def _medoids(self, level: int) -> tuple[np.ndarray, int]:
        where, root = self._files(self.path)
        with where.open_input_file(f"{root}/medoids/{level}.json") as f:
            d = json.loads(f.read())
        return np.array(d["medoids"], np.float64).reshape(len(d["medoids"]), -1), d["nprobe"]

    def commit(self) -> None:
        for x in self.state["levels"]:
            x["committed"] = True
        self._save()
        if self.meta.merge_levels > 1:
            self.merge()

    def merge(self) -> int:
        """Merge runs of committed levels of about one size (a power of merge_levels) into one; returns the number of merges.

        So a level is rewritten once a power of merge_levels, and their number stays
        logarithmic in the number of documents.
        """
        most, merges = max(2, self.meta.merge_levels or 8), 0
        while True:
            by: dict[int, list[dict]] = {}
            for x in self._levels():
                by.setdefault(int(math.log(max(x["docs"], 1), most)), []).append(x)
            some = next((v[:most] for _, v in sorted(by.items()) if len(v) >= most), None)
            if some is None:
                return merges
            self._rewrite_levels(some)
            merges += 1

    def compact(self) -> None:
        """Rewrite all levels as one, without deleted documents; ids stay."""
        for x in self.state["levels"]:
            x["committed"] = True
        if self.state["levels"]:
            self._rewrite_levels(list(self.state["levels"]))
        if self.state["deleted"]:
            self.state["deleted"] = 0
            self.state["deletes"] = self.state.get("deletes", 0) + 1
            self._save()

    def _rewrite_levels(self, old: list[dict]) -> None:
        """A new level with the documents of others that aren't deleted. The old files go only after the state names the new one."""
        s, ids = self.state, [x["id"] for x in old]
        paths = [f"{self.path}/docs/level={i}" for i in ids]
        docs = self._alive(self.spark.read.option("basePath", f"{self.path}/docs").parquet(*paths).drop("level"))
        first, kept, saved, auto = min(x["first"] for x in old), s["next_doc"], self._save, self.meta
        self._save, self.meta = (lambda: None), replace(self.meta, auto_commit_docs=0)  # one save for both
        try:
            self.index_documents(docs, id_column="doc_id")
        finally:
            self._save, self.meta = saved, auto
        new = s["levels"].pop()
        new |= {"committed": True, "first": first}
        s["levels"] = [new, *(x for x in s["levels"] if x["id"] not in ids)] if new["docs"] else [x for x in s["levels"] if x["id"] not in ids]
        s["next_doc"] = kept
        self._save()
        self._remove(old)

    def _remove(self, levels: list[dict]) -> None:
        where, root = self._files(self.path)
        for x in levels:
            for name in x["relations"]:
                at = f"{root}/{name}/level={x['id']}"
                if where.get_file_info(at).type != fs.FileType.NotFound:
                    where.delete_dir(at)

    # -- deletes and updates

    def delete_documents(self, ids) -> None:
        """ids: numbers, or a DataFrame with doc_id."""
        df = ids.select(F.col("doc_id").cast("bigint")) if isinstance(ids, DataFrame) else self.spark.createDataFrame([(int(i),) for i in ids], "doc_id bigint")
        df.distinct().write.mode("append").parquet(self._deletes())
        self.state["deleted"] = self.spark.read.parquet(self._deletes()).distinct().count()
        self._save()

    delete_document = lambda self, doc_id: self.delete_documents([doc_id])

    def delete_by_query(self, text: str, query_type: str = "intersection", fields=(), filters=(), realtime: bool = False, offset: int = 0, length: int | None = None, **options) -> None:
        """Delete all that a query matches; with offset or length, those places of its ranking only."""
        if offset or length is not None or options:
            options |= {"query_type": query_type, "fields": fields, "filters": filters, "realtime": realtime}
            found = self.search(text, result_type="Topk", offset=offset, length=length if length is not None else (1 << 31) - 1 - offset, with_documents=False, **options).results
        else:
            found = self.matches(Q.parse(text, self.meta, query_type), realtime, fields, score=False)
            if filters:
                found = found.join(facets.filtered(self.documents(realtime), filters).select("doc_id"), "doc_id", "left_semi")
        self.delete_documents(found)

    def update_documents(self, ids, docs: DataFrame) -> None:
        """The old documents go; the new ones get new ids."""
        self.delete_documents(ids)
        self.index_documents(docs)

    # -- statistics

    def stats(self, realtime: bool = False) -> tuple[int, float]:
        levels = self._levels(realtime)
        n = sum(x["docs"] for x in levels)
        return n, sum(x["length"] for x in levels) / n if n else 0.0

    def document_frequency(self, terms, realtime: bool = False) -> dict[str, int]:
        rows = self.relation("terms", realtime)
        if rows is None or not terms:
            return {}
        return dict(map(tuple, self._of_terms(rows, terms).groupBy("term").agg(F.sum("df")).collect()))

    def _of_terms(self, rows: DataFrame, terms) -> DataFrame:
        buckets = sorted({build.bucket_of(t, self.state["buckets"]) for t in terms})
        return rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(list(terms)))

    def info(self) -> DataFrame:
        s = self.state
        n, avg = self.stats()
        row = (self.meta.name, s["next_doc"], sum(x["docs"] for x in s["levels"] if not x["committed"]), n, max(0, sum(x["docs"] for x in s["levels"]) - s["deleted"]), s["deleted"], len(s["levels"]), len(self.schema.facets), round(avg, 6), self.vector_count())
        return self.spark.createDataFrame([row], "name string, next_doc_id bigint, uncommitted_docs bigint, committed_docs bigint, current_docs bigint, deleted_docs bigint, levels int, facets int, average_length double, vectors bigint")

    def vector_count(self) -> int:
        v = self.relation("vectors", True)
        return v.count() if v is not None else 0

    def string_facets(self, names=None, prefix: str = "", length: int = 0) -> DataFrame:
        names = names or [f.field for f in self.schema.facets if f.field_type.startswith("String")]
        return facets.index_facets(self.documents(), names, prefix, length)

    def facets_minmax(self) -> DataFrame:
        return facets.min_max(self.documents(), [f.field for f in self.schema.facets if f.field_type in NUMERIC])

    def dictionary(self) -> DataFrame | None:
        words, levels = self._dictionary_fields(), len(self._levels(True))
        if words is not None and len(words) == len(self.schema.lexical):  # the terms that are no n-grams
            d = self.relation("terms", True)
            d = d if d is None else d.where(~F.col("term").contains(" ")).select("term", "df")
        else:
            d = self.relation("dictionary", True)
        if loaded := self.state.get("dictionary"):
            more = self.spark.read.schema("term string, df bigint").csv(loaded)
            d = more if d is None else d.select("term", "df").union(more)
        if d is None:
            return None
        # a level has a term once
        d = d.groupBy("term").agg(F.sum("df").alias("df")) if levels != 1 or loaded else d.select("term", "df")
        return build.most_frequent(d, "df", self.meta.spelling_correction.max_dictionary_entries) if self.meta.spelling_correction else d

    def completions(self) -> DataFrame | None:
        self._write_completions()
        c, levels = self.relation("completions", True), len(self._levels(True))
        if loaded := self.state.get("completions"):
            more = self.spark.read.schema("gram string, n bigint").csv(loaded)
            c = more if c is None else c.select("gram", "n").union(more)
        if c is None:
            return None
        # a level has a gram once
        c = c.groupBy("gram").agg(F.sum("n").alias("n")) if levels != 1 or loaded else c.select("gram", "n")
        return build.most_frequent(c, "n", self.meta.query_completion.max_completion_entries) if self.meta.query_completion else c

    def save_dictionary(self, path: str) -> None:
        """As CSV: term, count."""
        self.dictionary().write.mode("overwrite").csv(path)

    def load_dictionary(self, path: str) -> DataFrame:
        """Add the entries of a CSV file to the index's own, for corrections."""
        self.state["dictionary"] = path
        self._save()
        return self.dictionary()

    def save_completions(self, path: str) -> None:
        """As CSV: words, count."""
        self.completions().write.mode("overwrite").csv(path)

    def load_completions(self, path: str) -> DataFrame:
        """Add the entries of a CSV file to the index's own, for suggestions."""
        self.state["completions"] = path
        self._save()
        return self.completions()

    # -- reads

    def get_document(self, doc_id: int, fields=(), realtime: bool = False, highlights=(), terms=(), distances=()) -> DataFrame:
        """The stored document; raises if it is deleted, not there, or not committed yet."""
        rows = self._present(self.documents(realtime).where(F.col("doc_id") == doc_id), fields, highlights, terms, distances)
        if rows.isEmpty():
            raise KeyError(f"no document {doc_id}")
        return rows

    def get_facet_value(self, doc_id: int, name: str) -> DataFrame:
        return facets.facet_value(self.documents(), doc_id, name)

    def _present(self, rows: DataFrame, fields=(), highlights=(), terms=(), distances=()) -> DataFrame:
        from .functions import geo

        names = [f.field for f in self.schema.fields if f.store and (not fields or f.field in fields)]
        out = [F.col(f"`{n}`") for n in names]
        out += [F.round(geo.distance(F.col(f"`{d['field']}`.lat"), F.col(f"`{d['field']}`.lon"), d["base"], d.get("unit", "Kilometers")), 6).alias(d["name"]) for d in distances]
        synonyms: dict[str, list[str]] = {}
        for a, b in self.state["synonyms"]:
            synonyms.setdefault(a, []).append(b)
        out += [highlight.highlighter(terms, h, synonyms)(F.col(f"`{h.field}`")).alias(h.name or h.field + "_highlight") for h in highlights]
        extra = [c for c in ("score",) if c in rows.columns]
        return rows.select("doc_id", *extra, *out)

    def iterate(self, doc_id: int | None = None, skip: int = 0, take: int = 1, include_deleted: bool = False, fields=(), include_document: bool = True) -> DataFrame:
        """Forward (take > 0) or backward documents from an id on (itself included), after skipping some; ascending ids either way."""
        rows = self.documents(include_deleted=include_deleted)
        rows = rows if include_document else rows.select("doc_id")
        key = F.col("doc_id").asc() if take > 0 else F.col("doc_id").desc()
        if doc_id is not None:
            rows = rows.where(F.col("doc_id") >= doc_id if take > 0 else F.col("doc_id") <= doc_id)
        rows = rows.orderBy(key).offset(skip).limit(abs(take)).orderBy("doc_id")
        return self._present(rows, fields) if include_document else rows

    # -- search

    def matches(self, q: Q.Query, realtime: bool = False, fields=(), score: bool = True) -> DataFrame:
        """doc_id, score of all matching documents that aren't deleted."""
        rows = self.relation("postings", realtime)
        allowed = [i for i, f in enumerate(self.schema.lexical) if f.field in fields] if fields else None
        if rows is None or q.empty:
            return self.spark.createDataFrame([], "doc_id bigint, score double")
        n, avgdl = self.stats(realtime)
        df = self.document_frequency(q.terms, realtime)
        if q.kind != "union" and any(t not in df for t in q.terms):
            return self.spark.createDataFrame([], "doc_id bigint, score double")
        out = lexical.match(self._of_terms(rows, [*q.terms, *q.excluded]), q, df, n, avgdl, [f.boost for f in self.schema.lexical], allowed or None, score)
        if self.meta.lexical_similarity == "Bm25fProximity" and score and q.kind == "phrase":
            out = self._proximity(out, rows, q, n, avgdl, realtime)
        return self._alive(out)

    def _proximity(self, out: DataFrame, rows: DataFrame, q: Q.Query, n: int, avgdl: float, realtime: bool) -> DataFrame:
        """Phrase scores by the n-grams that cover the phrases, with their own frequencies."""
        from .functions.words import word_list

        units = [" ".join(w) for p in q.phrases for _, w in Q.rewrite_phrase(p, set(word_list(self.meta.frequent_words)), self.meta.ngram_indexing)]
        units = list(dict.fromkeys([*units, *[t for t in q.terms if not any(t in p for p in q.phrases)]]))
        df = self.document_frequency(units, realtime)
        units = [u for u in units if u in df]
        if not any(" " in u for u in units):
            return out
        scored = lexical.match(self._of_terms(rows, units), Q.Query("union", units), df, n, avgdl, [f.boost for f in self.schema.lexical])
        return out.drop("score").join(scored, "doc_id")

    def search(
        self, text: str = "", query_type: str = "intersection", result_type: str = "TopkCount", offset: int = 0, length: int = 10, realtime: bool = False, fields=(), filters=(), query_facets=(), sort=(),
        mode: str = "lexical", query_vector=None, ann_mode: str = "All", nprobe: int | None = None, similarity_threshold: float | None = None, enable_empty_query: bool = False,
        rewriting: str = "SearchOnly", suggestions: int = 10, return_fields=(), highlights=(), distances=(), with_documents: bool = True,
    ) -> Result:
        """Search of one of the modes lexical, vector or hybrid; result_type: Count, Topk or TopkCount."""
        res = Result(query=text)
        if length == 0:
            result_type = "Count" if result_type == "TopkCount" else result_type
        if rewriting != "SearchOnly" and text:
            self._rewrite(res, text, rewriting, suggestions)
            if rewriting == "SuggestOnly":
                return res
            text = res.query
        docs = self.documents(realtime)
        empty = not text.strip() and query_vector is None
        if empty and not enable_empty_query:
            res.results = docs.limit(0)
            return res
        terms: list[str] = []
        if empty:
            found = docs.select("doc_id")
            sort = sort or (facets.ResultSort("_id", "descending"),)
        else:
            q = Q.parse(text, self.meta, query_type)
            terms = q.terms
            found = self.matches(q, realtime, fields) if mode in ("lexical", "hybrid") else None
        res.query_terms = terms
        ok = facets.filtered(docs, filters)
        if mode != "lexical" and query_vector is not None:
            near = self._near(query_vector, realtime, ann_mode, nprobe, similarity_threshold)
            near = near.join(ok.select("doc_id"), "doc_id", "left_semi")
            if mode == "hybrid":
                k = offset + length
                lex = found.join(ok.select("doc_id"), "doc_id", "left_semi") if filters else found
                found = vector.reciprocal_rank_fusion(lexical.rank(lex, k), lexical.rank(near, k))
            else:
                found = near
        elif filters:
            found = found.join(ok.select("doc_id"), "doc_id", "left_semi")
        if result_type in ("Count", "TopkCount"):
            res.result_count_total = found.count()
            known = found.select("doc_id")
            res.facets = {f.field: facets.facet(docs.join(known, "doc_id", "left_semi"), f) for f in query_facets if f.length or f.ranges}
        if result_type in ("Topk", "TopkCount") and length:
            keys = [k.field for k in sort if k.field not in ("_id", "_score")]
            rows = found.withColumn("score", F.round("score", 6)) if "score" in found.columns else found
            if keys:
                rows = rows.join(docs.select("doc_id", *keys), "doc_id")
            top = facets.top(rows, sort, length, offset).drop(*keys)
            if with_documents:
                top = top.join(docs, "doc_id")
                top = top.orderBy(*facets.order(top, sort))
                top = self._present(top, return_fields, highlights, terms, distances)
            res.results = top
            if result_type == "TopkCount":
                res.result_count = max(0, min(length, res.result_count_total - offset))
        return res

    def _near(self, query, realtime: bool, ann_mode: str, nprobe: int | None, least: float | None) -> DataFrame:
        """doc_id, score by similarity to a vector, or to a text through the embedder; nprobe None: each level's own."""
        rows, kind = self.relation("vectors", realtime), self.meta.vector_similarity
        if rows is None:
            return self.spark.createDataFrame([], "doc_id bigint, score double")
        if isinstance(query, str):
            query = self.embedder([query])[0]
        q = np.asarray(query, np.float64)
        if ann_mode != "All":
            # clusters are folders, so that this filter prunes what is read
            chosen = F.lit(False)
            for x in self._levels(realtime):
                if "vectors" in x["relations"]:
                    medoids, own = self._medoids(x["id"])
                    ids = vector.probe(q, medoids, (nprobe or own) if "Nprobe" in ann_mode else None, least if "threshold" in ann_mode else None, kind)
                    chosen = chosen | ((F.col("level") == x["id"]) & F.col("cluster_id").isin(ids))
            rows = rows.where(chosen)
        if self.meta.quantization == "RotatedI8":
            q = V.rotate(q[None])[0]
        return vector.exact(self._alive(rows), q, kind, least)

    def _rewrite(self, res: Result, text: str, mode: str, length: int) -> None:
        words = Q.split(text, self.meta.tokenizer)
        grams, terms, config = self.completions(), self.dictionary(), self.meta.spelling_correction
        better = rewrite.correct(terms, words, config) if terms is not None and config else words
        if grams is not None and words:
            typing = not text.endswith(" ")
            res.suggestions = [g for g, _ in (rewrite.suggest(grams, terms, words, config, typing, length) if terms is not None else rewrite.expand(grams, words, typing, length))]
        if better != words and " ".join(better) not in res.suggestions:
            res.suggestions.append(" ".join(better))
        if mode == "SearchRewrite" and res.suggestions and not any(c in text for c in '+-"'):
            res.query = res.suggestions[0] if better == words else " ".join(better)

    # -- vectors

    def encode_lengths(self) -> DataFrame:
        """doc_id, field_id, dl and its byte code."""
        rows = self.relation("postings", True).groupBy("doc_id", "field_id").agg(F.first("dl").alias("dl"))
        code = F.udf(analysis.length_to_byte, "int")
        return rows.withColumn("code", code("dl"))
