"""The JSON contract of the service: request dictionaries in, result dictionaries out; routes, keys and limits.

``Service.handle(method, path, headers, body)`` answers every route; ``serve`` puts the
standard library's HTTP server in front of it. Results are bounded by the request's length.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import time
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .functions.highlight import Highlight
from .index import Index, Result
from .operators import facets
from .plans.query import split
from .schema import IndexMeta, Schema, SchemaField, SpellingCorrection, QueryCompletion


def _range(d: dict) -> facets.Range:
    return facets.Range(d["start"], d["end"])


def facet_filter(d: dict) -> facets.FacetFilter:
    f = d.get("filter")
    if isinstance(f, list):
        return facets.FacetFilter(d["field"], values=tuple(f))
    if "base" in f:
        return facets.FacetFilter(d["field"], distance=facets.Distance(tuple(f["base"]), f["start"], f["end"], f.get("unit", "Kilometers")))
    return facets.FacetFilter(d["field"], range=_range(f))


def query_facet(d: dict) -> facets.QueryFacet:
    return facets.QueryFacet(d["field"], d.get("prefix", ""), d.get("length", 10), tuple((r[0], r[1]) for r in d.get("ranges", ())), d.get("range_type", "CountWithinRange"), d.get("base") and tuple(d["base"]), d.get("unit", "Kilometers"))


def result_sort(d: dict) -> facets.ResultSort:
    return facets.ResultSort(d["field"], d.get("order", "descending").lower(), d.get("base") and tuple(d["base"]), d.get("unit", "Kilometers"))


def highlight(d: dict) -> Highlight:
    return Highlight(d["field"], d.get("name", ""), d.get("fragment_number", 0), d.get("fragment_size", 0), d.get("highlight_markup", False), d.get("pre_tags", "<b>"), d.get("post_tags", "</b>"))


def search(index: Index, request: dict) -> dict:
    """A search request, as a dictionary, to a result of plain values."""
    start = time.perf_counter()
    vector = request.get("query_vector")
    r: Result = index.search(
        request.get("query", request.get("query_string", "")),
        query_type=request.get("query_type_default", "intersection").lower(),
        result_type=request.get("result_type", "TopkCount"),
        offset=request.get("offset", 0), length=request.get("length", 10), realtime=request.get("realtime", False),
        fields=tuple(request.get("field_filter", ())), filters=tuple(map(facet_filter, request.get("facet_filter", ()))),
        query_facets=tuple(map(query_facet, request.get("query_facets", ()))), sort=tuple(map(result_sort, request.get("result_sort", ()))),
        mode=request.get("search_mode", "lexical").lower(), query_vector=vector, ann_mode=request.get("ann_mode", "All"), nprobe=request.get("nprobe", 16),
        similarity_threshold=request.get("similarity_threshold"), enable_empty_query=request.get("enable_empty_query", False),
        rewriting=request.get("query_rewriting", "SearchOnly"), suggestions=request.get("suggestion_length", 10), return_fields=tuple(request.get("fields", ())),
        highlights=tuple(map(highlight, request.get("highlights", ()))), distances=tuple(request.get("distance_fields", ())),
    )
    hits = []
    for row in r.results.collect() if r.results is not None else ():
        d = row.asDict(recursive=True)
        hits.append({"_id": d.pop("doc_id"), "_score": d.pop("score", 0.0), **{k: v for k, v in d.items() if v is not None}})
    return {
        "original_query": request.get("query", request.get("query_string", "")), "query": r.query, "time": int((time.perf_counter() - start) * 1e9), "offset": request.get("offset", 0), "length": request.get("length", 10),
        "count": len(hits), "count_total": r.result_count_total, "query_terms": r.query_terms, "results": hits,
        "facets": {k: [tuple(x) for x in f.collect()] for k, f in r.facets.items()}, "suggestions": r.suggestions,
    }


@dataclass
class ApiKey:
    hash: str
    quota: dict = field(default_factory=lambda: {"indices_max": 10, "documents_max": 10**9, "rate_limit": None})
    indexes: dict[int, str] = field(default_factory=dict)
    window: list[float] = field(default_factory=list)
    violations: int = 0


GRACE = 10


class Service:
    """Indexes by key. The master key makes and drops keys; a key's indexes are its own."""

    def __init__(self, spark: SparkSession, folder: str, master_key: str):
        self.spark, self.folder, self.master = spark, folder, master_key
        self.keys: dict[str, ApiKey] = {}
        self.open: dict[tuple[str, int], Index] = {}

    @staticmethod
    def hash(key: str) -> str:
        return hashlib.sha256(key.encode()).hexdigest()

    def create_key(self, quota: dict | None = None) -> str:
        key = base64.b64encode(os.urandom(32)).decode()
        k = ApiKey(self.hash(key))
        k.quota |= quota or {}
        self.keys[k.hash] = k
        return key

    def allow(self, key: ApiKey) -> bool:
        """At most rate_limit requests a second; some violations are forgiven."""
        limit, now = key.quota.get("rate_limit"), time.monotonic()
        if not limit:
            return True
        key.window = [t for t in key.window if t > now - 1]
        key.window.append(now)
        if len(key.window) > limit:
            key.violations += 1
            return key.violations <= GRACE
        return True

    def handle(self, method: str, path: str, headers: dict | None = None, body: bytes | str | None = None):
        """(status, JSON value)."""
        headers = {k.lower(): v for k, v in (headers or {}).items()}
        parts = [p for p in path.split("?")[0].split("/") if p]
        if parts[:2] == ["api", "v1"]:
            parts = parts[2:]
        data = json.loads(body) if body else None
        try:
            if parts == ["live"]:
                return 200, "relquarry"
            given = headers.get("apikey", "")
            if parts == ["apikey"] and method in ("POST", "DELETE"):
                if given != self.master:
                    return 401, "master key needed"
                if method == "POST":
                    return 200, self.create_key(data)
                self.keys.pop(self.hash(data["apikey"]), None)
                return 200, len(self.keys)
            key = self.keys.get(self.hash(given))
            if key is None:
                return 401, "unknown key"
            if not self.allow(key):
                return 429, "too many requests"
            if parts == ["apikey"] and method == "GET":
                return 200, [self._info(self._index(key, i)) for i in key.indexes]
            if parts == ["index"] and method == "POST":
                return self._create(key, data)
            if parts[:1] == ["index"] and len(parts) >= 2 and re.fullmatch(r"\d+", parts[1]):
                return self._on_index(method, key, int(parts[1]), parts[2:], data)
            return 404, "no such route"
        except KeyError as e:
            return 404, str(e)
        except (ValueError, TypeError) as e:
            return 400, str(e)

    def _index(self, key: ApiKey, number: int) -> Index:
        if number not in key.indexes:
            raise KeyError(f"no index {number}")
        at = (key.hash, number)
        if at not in self.open:
            self.open[at] = Index.open(self.spark, key.indexes[number])
        return self.open[at]

    def _create(self, key: ApiKey, d: dict):
        if len(key.indexes) >= key.quota["indices_max"]:
            return 429, "too many indexes"
        number = max(key.indexes, default=-1) + 1
        schema = Schema(tuple(SchemaField(**f) for f in d["schema"]))
        names = ("lexical_similarity", "tokenizer", "stemmer", "ngram_indexing", "document_compression", "vector_similarity", "frequent_words")
        meta = IndexMeta(name=d.get("index_name", "index"), **{k: d[k] for k in names if k in d}, stop_words=tuple(d.get("stop_words", ())), spelling_correction=SpellingCorrection(**d["spelling_correction"]) if d.get("spelling_correction") else None, query_completion=QueryCompletion(**d["query_completion"]) if d.get("query_completion") else None)
        path = f"{self.folder}/{key.hash[:16]}/{number}"
        self.open[key.hash, number] = Index.create(self.spark, path, schema, meta, d.get("synonyms", ()))
        key.indexes[number] = path
        return 200, number

    @staticmethod
    def _info(index: Index) -> dict:
        return index.info().first().asDict()

    def _on_index(self, method: str, key: ApiKey, number: int, rest: list[str], data):
        index = self._index(key, number)
        what = rest[0] if rest else ""
        if not what:
            if method == "GET":
                return 200, self._info(index)
            if method == "PATCH":
                index.commit()
                return 200, sum(x["docs"] for x in index.state["levels"])
            if method == "PUT":
                index.close()
                del self.open[key.hash, number]
                return 200, len(key.indexes)
            if method == "DELETE":
                index.drop()
                del key.indexes[number], self.open[key.hash, number]
                return 200, len(key.indexes)
        if what == "query":
            return 200, search(index, data or {})
        if what == "doc":
            if method == "GET":
                request = data or {}
                doc = index.get_document(int(rest[1]), tuple(request.get("fields", ())), highlights=tuple(map(highlight, request.get("highlights", ()))), terms=tuple(split(" ".join(request.get("query_terms", ())), index.meta.tokenizer)), distances=tuple(request.get("distance_fields", ())))
                return 200, doc.first().asDict(recursive=True)
            if method == "POST":
                docs = data if isinstance(data, list) else [data]
                if index.state["next_doc"] + len(docs) > key.quota["documents_max"]:
                    return 429, "too many documents"
                return 200, self._add(index, docs)
            if method == "PATCH":
                pairs = data if data and isinstance(data[0], list) else [data]
                index.delete_documents([p[0] for p in pairs])
                return 200, self._add(index, [p[1] for p in pairs])
            if method == "DELETE":
                if data == "clear":
                    index.clear()
                elif isinstance(data, dict):
                    index.delete_by_query(data.get("query", ""), query_type=data.get("query_type_default", "intersection").lower(), offset=data.get("offset", 0), length=data.get("length", 10), fields=tuple(data.get("field_filter", ())), filters=tuple(map(facet_filter, data.get("facet_filter", ()))))
                else:
                    index.delete_documents(data if isinstance(data, list) else [int(rest[1])] if len(rest) > 1 else [data])
                return 200, index.info().first()["current_docs"]
        if what == "synonyms":
            if method == "GET":
                return 200, index.state["synonyms"]
            (index.set_synonyms if method == "POST" else index.add_synonyms)([x["terms"] if isinstance(x, dict) else x for x in data])
            return 200, len(index.state["synonyms"])
        if what == "iterator":
            d = data or {}
            rows = index.iterate(d.get("document_id"), d.get("skip", 0), d.get("take", 1), d.get("include_deleted", False), tuple(d.get("fields", ())), d.get("include_document", True)).collect()
            return 200, {"skip": d.get("skip", 0), "results": [{"doc_id": r["doc_id"], "doc": r.asDict(recursive=True)} for r in rows]}
        if what == "file":
            from .sources.readers import read_files

            if method == "GET":
                row = index.get_document(int(rest[1]), ("url",)).first()
                return 200, base64.b64encode(read_files(self.spark, row["url"]).first()["content"]).decode()
            from .sources.readers import read_pdf

            return 200, index.index_documents(read_pdf(self.spark, data["path"]))
        return 404, "no such route"

    @staticmethod
    def _add(index: Index, docs: list[dict]) -> int:
        rows = [json.dumps({k: json.dumps(v) if k in index.schema and index.schema[k].field_type in ("Json",) and not isinstance(v, str) else v for k, v in d.items()}) for d in docs]
        spark = index.spark
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(r,) for r in rows], "v string").select(F.from_json("v", index.schema.struct()).alias("d")).select("d.*")
        return index.index_documents(df.coalesce(1))


def serve(service: Service, host: str = "127.0.0.1", port: int = 8080):
    """A blocking HTTP server."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        def _answer(self):
            body = self.rfile.read(int(self.headers.get("content-length") or 0))
            status, value = service.handle(self.command, self.path, dict(self.headers), body)
            out = json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("content-type", "application/json")
            self.send_header("content-length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        do_GET = do_POST = do_PUT = do_PATCH = do_DELETE = _answer

    server = ThreadingHTTPServer((host, port), Handler)
    server.serve_forever()
