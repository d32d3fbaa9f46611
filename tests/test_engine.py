"""Scenarios of a small index, functions against plain Python, and readers."""

import json
import math
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from relquarry.api import Service
from relquarry.functions import analysis, geo, highlight, stemmers
from relquarry.functions import vectors as V
from relquarry.index import Index
from relquarry.operators import facets, rewrite, vector
from relquarry.plans import query as Q
from relquarry.schema import IndexMeta, QueryCompletion, Schema, SchemaField, SpellingCorrection
from relquarry.sources import readers
from relquarry.streaming.ingest import read_stream, stream_into

TEXT = Schema((SchemaField("title"), SchemaField("body", index_lexical=True, longest=True), SchemaField("url"), SchemaField("town", field_type="String16", facet=True), SchemaField("age", field_type="U8", facet=True), SchemaField("place", field_type="Point", facet=True)))
ROWS = [
    ("title1 test", "body1", "url1", "Berlin", 20, (52.5, 13.4)),
    ("title1 test", "body1", "url1", "Berlin", 61, (52.4, 13.1)),
    ("title2", "body2 test", "url2", "Warsaw", 80, (52.2, 21.0)),
    ("title3 test", "body3 test", "url3", "New York", 33, (40.7, -74.0)),
]
META = IndexMeta(lexical_similarity="Bm25f")


def make(spark, path, rows=ROWS, meta=META, schema=TEXT):
    index = Index.create(spark, f"file://{path}", schema, meta, buckets=2)
    index.index_documents(spark.createDataFrame(rows, schema.struct()))
    return index


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    i = make(spark, tmp_path_factory.mktemp("i"))
    i.commit()
    return i


def ids(df):
    return [r.doc_id for r in df.collect()]


def test_intersection_and_count(index):
    r = index.search("+body2 +test")
    assert (r.result_count, r.result_count_total, ids(r.results)) == (1, 1, [2])
    r = index.search("test", "union", "Count")
    assert (r.result_count_total, r.results) == (2, None)
    assert ids(index.search("test -body3").results) == [2]
    assert index.search("test nothing").result_count_total == 0


def test_empty_query_and_orders(index):
    assert ids(index.search("", enable_empty_query=True).results) == [3, 2, 1, 0]
    assert ids(index.search("", enable_empty_query=True, sort=(facets.ResultSort("_id"),)).results) == [0, 1, 2, 3]
    assert ids(index.search("").results) == []
    assert index.search("", enable_empty_query=True, length=0).results is None


def test_iterator(index):
    got = [ids(index.iterate(*a)) for a in ((None, 0, 1), (None, 0, -1), (3, 1, -1), (0, 1, 1))]
    assert got == [[0], [3], [2], [1]]
    assert ids(index.iterate(None, 0, -3)) == [1, 2, 3]


def test_facets_filters_and_geography(index):
    q = (facets.QueryFacet("town"), facets.QueryFacet("age", ranges=(("0", 0), ("30", 30), ("60", 60))), facets.QueryFacet("place", ranges=(("near", 0.0), ("far", 1000.0)), base=(52.5, 13.4)))
    r = index.search("", enable_empty_query=True, query_facets=q)
    assert [tuple(x) for x in r.facets["town"].collect()] == [("Berlin", 2), ("New York", 1), ("Warsaw", 1)]
    assert [tuple(x) for x in r.facets["age"].collect()] == [("0", 1), ("30", 1), ("60", 2)]
    assert [tuple(x) for x in r.facets["place"].collect()] == [("near", 3), ("far", 1)]
    f = (facets.FacetFilter("age", range=facets.Range(21, 65)), facets.FacetFilter("town", ("Berlin", "New York")))
    assert ids(index.search("body1", filters=f).results) == [1]
    near = facets.FacetFilter("place", distance=facets.Distance((52.5, 13.4), 0, 30))
    assert sorted(ids(index.search("", enable_empty_query=True, filters=(near,)).results)) == [0, 1]
    by = facets.ResultSort("place", "ascending", (40.0, -74.0))
    assert ids(index.search("", enable_empty_query=True, sort=(by,)).results)[0] == 3
    r = index.search("test", distances=({"field": "place", "name": "far", "base": (40.7, -74.0)},)).results.collect()
    assert {x.doc_id: x.far == 0 for x in r} == {2: False, 3: True}
    assert [tuple(x) for x in index.facets_minmax().collect()] == [("age", 20.0, 80.0)]
    assert index.get_facet_value(2, "town").first()["value"] == "Warsaw"


def test_delete_update_realtime_reopen_and_compact(spark, tmp_path):
    i = make(spark, tmp_path / "x")
    assert i.search("body1").result_count_total == 0
    assert i.search("body1", realtime=True).result_count_total == 2
    i.commit()
    i.delete_document(0)
    assert ids(i.search("body1").results) == [1]
    with pytest.raises(KeyError):
        i.get_document(0)
    i.update_documents([1], spark.createDataFrame([("t", "body9", "u", "Rome", 5, None)], TEXT.struct()))
    i.commit()
    assert ids(i.search("body9").results) == [4]
    i = Index.open(spark, f"file://{tmp_path}/x")
    before = i.search("test", "union").results.select("doc_id").collect()
    i.compact()
    assert i.search("test", "union").results.select("doc_id").collect() == before and i.stats()[0] == 3
    i.delete_by_query("body2")
    assert i.search("test", "union").result_count_total == 1
    i.clear()
    i.index_document({"title": "a", "body": "body1"})
    i.commit()
    assert i.search("body1").result_count_total == 1 and i.get_document(0).first().body == "body1"


def test_query_parsing():
    m = META
    q = Q.parse('+a b -c "d e"', m, "union")
    assert (q.kind, q.terms, q.phrases, q.excluded) == ("phrase", ["a", "b", "d", "e"], [["d", "e"]], ["c"])
    assert Q.parse("a b", m, "union").kind == "union" and Q.parse("+a b", m, "union").kind == "intersection"
    assert Q.parse('"a"', m, "union").kind == "intersection"
    assert Q.ngram_terms(["the", "who", "of", "the"], {"the", "of"}, 9) == [(2, ["of", "the"])]
    assert Q.rewrite_phrase("to be or not to be".split(), set("to be or not".split()), 9) == [(0, ["to", "be", "or"]), (3, ["not", "to", "be"])]


def test_lengths_and_bytes(spark):
    n = [*range(0, 400), 1000, 4095, 69_999]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(n)], "i int, n int").orderBy("i").select(analysis.quantized_length(F.col("n"))).collect()]
    for x, y in zip(n, got):
        rest = x - 24
        s = max(0, rest.bit_length() - 4) if x >= 32 else 0
        assert y == (x if x < 32 else 24 + (rest >> s << s)) == analysis.byte_to_length(analysis.length_to_byte(x))


def test_tokenizers(spark):
    df = spark.createDataFrame([("Ärger C++ -foo it's_x  Don't ﬁne Ⅳ",), (None,)], "t string")
    run = lambda k: [r[0] for r in df.select(analysis.tokens("t", k)).collect()]
    assert run("UnicodeAlphanumeric")[0][:4] == ["ärger", "c++", "foo", "it"]
    assert run("AsciiAlphabetic")[0][:3] == ["rger", "c", "foo"] and run("Whitespace")[0][0] == "Ärger" and run("WhitespaceLowercase")[0][1] == "c++"
    folded = run("UnicodeAlphanumericFolded")[0]
    assert folded[0] == "aerger" and "don" in folded and "fine" in folded and "iv" in folded
    assert run("UnicodeAlphanumeric")[1] == []
    assert analysis.zh_tokens("我爱北京 ok", {"我": -1, "爱": -1, "北京": -1, "北": -3, "京": -3}) == ["我", "爱", "北京", "ok"]
    assert [stemmers.english(w) for w in "caresses ponies relational hopping agreed happy generalizations".split()] == ["caress", "poni", "relat", "hop", "agre", "happi", "gener"]
    assert analysis.json_strings(json.loads('{"a": {"b": "John"}, "n": 1, "c": ["Smith", {"d": "x"}]}')) == "John Smith x"
    assert analysis.chunks("One. Two! Three?", 6) == ["One.", "Two!", "Three?"]


def test_phrase_with_repeats_synonyms_and_ngrams(spark, tmp_path):
    rows = [("who is who here", ), ("who is here",), ("the who of the",), ("pump it up",)]
    schema = Schema((SchemaField("body", index_lexical=True),))
    i = make(spark, tmp_path / "p", rows, IndexMeta(frequent_words=("who", "is", "the", "of")), schema)
    i.commit()
    assert ids(i.search('"who is who"').results) == [0] and sorted(ids(i.search('"who is"').results)) == [0, 1]
    assert i.document_frequency(["who is", "of the", "who is who"]) == {"who is": 2, "of the": 1, "who is who": 1}
    i.set_synonyms([["up", "high"]])
    i.index_documents(spark.createDataFrame([("jump up now",)], schema.struct()))
    i.commit()
    assert ids(i.search("high").results) == [4] and ids(i.search('"jump high now"').results) == [4]


def test_spelling_and_completion(spark, tmp_path):
    schema = Schema((SchemaField("body", index_lexical=True, dictionary_source=True, completion_source=True),))
    meta = IndexMeta(spelling_correction=SpellingCorrection(count_threshold=1, term_length_threshold=(2, 8)), query_completion=QueryCompletion(), ngram_indexing=0)
    i = make(spark, tmp_path / "s", [("blue whale ocean",), ("blue whale song",), ("red fox",), ("quick silver",)], meta, schema)
    i.commit()
    config = meta.spelling_correction
    assert rewrite.correct(i.dictionary(), ["bleu", "whale"], config) == ["blue", "whale"]
    assert rewrite.correct(i.dictionary(), ["bluewhale"], config) == ["blue", "whale"]
    assert rewrite.correct(i.dictionary(), ["oc", "ean"], config) == ["ocean"]
    assert [g for g, _ in rewrite.expand(i.completions(), ["blue", "wh"])][0] == "blue whale"
    r = i.search("bleu whael", rewriting="SearchRewrite")
    assert r.query == "blue whale" and r.result_count_total == 2
    assert i.search("red fo", rewriting="SuggestOnly").suggestions[0] == "red fox"
    assert rewrite.damerau_levenshtein("teh", "the") == 1 and rewrite.damerau_levenshtein("ca", "abc") == 2


def test_highlighting():
    m = highlight.matcher(["art", "start"])
    h = highlight.Highlight("t", highlight_markup=True)
    assert highlight.snippet("Start the art", m, h) == "<b>Start</b> the <b>art</b>"
    k = highlight.Highlight("t", fragment_number=1, fragment_size=40)
    assert highlight.snippet("No match here. The art of start. Art again.", m, k) == "The art of start."
    assert highlight.snippet(None, m, k) is None


def test_geography(spark):
    rng = random.Random(1)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(200)]
    df = spark.createDataFrame(points, "lat double, lon double")
    for r in df.select("lat", "lon", geo.morton(F.col("lat"), F.col("lon")).alias("m")).collect():
        code = geo.encode_morton(r.lat, r.lon)
        assert r.m & (1 << 64) - 1 == code
        assert np.allclose(geo.decode_morton(code), (r.lat, r.lon), atol=1e-6)
    got = {(r.lat, r.lon) for r in df.where(geo.within(F.col("lat"), F.col("lon"), (0.5, -0.5), 0, 5000)).collect()}

    def far(a):
        x = math.radians(a[1] + 0.5) * math.cos(math.radians((a[0] + 0.5) / 2))
        return 6371.0087714 * math.hypot(x, math.radians(a[0] - 0.5))

    assert got == {p for p in points if far(p) < 5000} and got


def test_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 20)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id bigint, vector array<float>")
    q = x[5]
    for kind, s in (("Dot", x @ q), ("Cosine", x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q)), ("Euclidean", -((x - q) ** 2).sum(1))):
        got = {r.doc_id: r.score for r in vector.exact(df, q, kind).collect()}
        assert np.allclose([got[i] for i in range(300)], s, atol=1e-4)
        col = {r.doc_id: r.s for r in df.select("doc_id", V.similarity(kind, F.col("vector"), V.literal(q)).alias("s")).collect()}
        assert np.allclose([col[i] for i in range(300)], s, atol=1e-4)
    r = V.rotate(x.astype(float))
    assert np.allclose(r @ r.T, x @ x.T, atol=1e-3)
    codes, scale = V.rotated_int8(x)
    assert np.abs((codes.astype(float) @ codes.T) * np.outer(scale, scale) - x @ x.T).max() < 0.6
    medoids = vector.fit_medoids(df)
    assert len(medoids) <= 34 and vector.search(vector.assign(df, medoids), q, medoids, "Nprobe", len(medoids)).count() == 300
    qq = df.where("doc_id < 10").select(F.col("doc_id").alias("query_id"), F.col("vector").alias("query"))
    truth = vector.search_many(df, qq, 10)
    assert vector.recall(truth, truth).first()[0] == 1.0
    lex = spark.createDataFrame([(1, 3.0), (2, 2.0)], "doc_id bigint, score double")
    fused = {r.doc_id: r.score for r in vector.reciprocal_rank_fusion(lex, lex.where("doc_id = 2")).collect()}
    assert fused == pytest.approx({1: 1 / 0.6, 2: 1 / 1.6 + 1 / 0.6})


def test_vector_index_and_hybrid(spark, tmp_path):
    schema = Schema((SchemaField("vector", field_type="Json", index_vector=True), SchemaField("name", index_lexical=True)))
    rows = [(json.dumps([(128 * k + j) / 1000 for j in range(1, 129)]), f"doc{k} all") for k in range(3)]
    i = make(spark, tmp_path / "v", rows, IndexMeta(vector_similarity="Euclidean"), schema)
    i.commit()
    r = i.search(mode="vector", query_vector=[j / 1000 for j in range(1, 129)])
    assert ids(r.results) == [0, 1, 2] and r.results.first().score == 0
    assert sorted(ids(i.search("doc2 all", "union", mode="hybrid", query_vector=[j / 1000 for j in range(1, 129)]).results)) == [0, 1, 2]


def test_readers(spark, tmp_path):
    schema = Schema((SchemaField("a"), SchemaField("n", field_type="I64"), SchemaField("tags", field_type="StringSet16")))
    docs = [{"a": "x", "n": 1, "tags": ["p", "q"]}, {"a": "y\nz", "n": None}]
    (tmp_path / "array.json").write_text(json.dumps(docs))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, docs)))
    (tmp_path / "joined.json").write_text("".join(json.dumps(d, indent=1) for d in docs))
    for f in ("array", "lines", "joined"):
        assert [tuple(r) for r in readers.read_json(spark, f"{tmp_path}/{f}.json", schema).collect()] == [("x", 1, ["p", "q"]), ("y\nz", None, None)]
    (tmp_path / "t.psv").write_text('h|h|h|h\nx|1|p_q|extra\n"y|y"|bad\nz|3|r\n')
    got = readers.read_csv(spark, f"{tmp_path}/t.psv", schema, has_header=True, num_docs=2).collect()
    assert [tuple(r) for r in got] == [("x", 1, ["p", "q"]), ("y|y", None, None)]
    (tmp_path / "v.fvecs").write_bytes(b"".join(struct.pack("<i3f", 3, i, 0.5, -1) for i in range(5)))
    (tmp_path / "v.ivecs").write_bytes(b"".join(struct.pack("<i2i", 2, i, 7) for i in range(4)))
    assert [tuple(r) for r in readers.read_fvecs(spark, f"{tmp_path}/v.fvecs").orderBy("id").collect()][4] == (4, [4.0, 0.5, -1.0])
    assert readers.read_ivecs(spark, f"{tmp_path}/v.ivecs").count() == 4
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.pdf").write_bytes(b"%PDF-1.4\n1 0 obj <</Title (My Title) /CreationDate (D:20200102030405Z)>> endobj\n2 0 obj <</Length 30>>\nstream\nBT (Hello) Tj ( world) Tj ET\nendstream\nendobj")
    r = readers.read_pdf(spark, str(tmp_path)).first()
    assert (r.title, r.body, r.date) == ("My Title", "Hello world", 1577934245)
    assert readers.read_files(spark, f"{tmp_path}/d").count() == 1


@pytest.mark.parametrize("indent", [None, 1])
def test_a_file_of_several_json_arrays(spark, tmp_path, indent):
    schema = Schema((SchemaField("n", field_type="I64"), SchemaField("o", field_type="Text")))
    docs = [{"n": k, "o": "[{" if k % 2 else None} for k in range(12)]
    for name, part in (("a", docs[:7]), ("b", docs[7:])):
        (tmp_path / f"{name}.json").write_text("\n".join(json.dumps(part[k : k + 3], indent=indent) for k in range(0, len(part), 3)) + "\n[]\n")
    got = readers.read_json(spark, str(tmp_path), schema).collect()
    assert sorted(map(tuple, got)) == [(d["n"], d["o"]) for d in docs]
    (tmp_path / "b.json").write_text('[{"n": 1},')
    assert sorted(map(tuple, readers.read_json(spark, f"{tmp_path}/b.json", schema).collect()), key=repr) in ([(1, None)], [(None, None)], [(1, None), (None, None)])


def test_stream_into_index(spark, tmp_path):
    schema = Schema((SchemaField("body", index_lexical=True),))
    i = Index.create(spark, f"file://{tmp_path}/s", schema, META, buckets=2)
    for k in range(3):
        spark.createDataFrame([(f"word{k} all",)], schema.struct()).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream_into(i, read_stream(spark, f"{tmp_path}/in", schema, files_per_trigger=1), f"file://{tmp_path}/cp").awaitTermination()
    assert i.search("all").result_count_total == 3 and len(i.state["levels"]) == 3
    n = i.state["next_doc"]
    i.index_documents(spark.createDataFrame([("again all",)], schema.struct()), batch=i.state["levels"][-1]["batch"])
    assert i.state["next_doc"] == n and len(i.state["levels"]) == 3


def test_service(spark, tmp_path):
    s = Service(spark, f"file://{tmp_path}/svc", "master")
    call = lambda m, p, d=None, k=None: s.handle(m, "/api/v1/" + p, {"apikey": k or ""}, json.dumps(d) if d is not None else None)
    assert call("GET", "live")[0] == 200 and call("POST", "apikey")[0] == 401
    key = call("POST", "apikey", {}, "master")[1]
    fields = [{"field": "title", "index_lexical": True}, {"field": "town", "field_type": "String16", "facet": True}]
    assert call("POST", "index", {"index_name": "i", "schema": fields}, key) == (200, 0)
    assert call("POST", "index/0/doc", [{"title": "a test", "town": "Rome"}, {"title": "b test", "town": "Oslo"}], key) == (200, 2)
    call("PATCH", "index/0", None, key)
    r = call("POST", "index/0/query", {"query": "test", "query_facets": [{"field": "town"}], "facet_filter": [{"field": "town", "filter": ["Oslo"]}]}, key)[1]
    assert r["count_total"] == 1 and r["results"][0]["title"] == "b test" and r["facets"]["town"] == [("Oslo", 1)]
    assert call("GET", "index/0/doc/1", None, key)[1]["town"] == "Oslo"
    assert call("DELETE", "index/0/doc", [1], key) == (200, 1) and call("GET", "index/0/doc/1", None, key)[0] == 404
    assert call("POST", "index/0/iterator", {"take": 5}, key)[1]["results"][0]["doc_id"] == 0
    assert call("POST", "index/0/synonyms", [["a", "b"]], key)[0] == 200 and call("GET", "index/0", None, key)[1]["current_docs"] == 1
    assert call("DELETE", "index/0", None, key) == (200, 0) and call("GET", "nothing", None, key)[0] == 404


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered_probe_has_the_recall(spark, monkeypatch, sf):
    from pathlib import Path

    from relquarry.plans import catalogue

    data = f"/root/testdata/{sf}"
    if not Path(data).exists():
        pytest.skip("no test tables here")
    assert catalogue.QUERIES["recall_at_10"](spark, data).first().recall >= 0.9
    assert catalogue.QUERIES["vec_ivf_nprobe"](spark, data).count() == 10


@pytest.mark.parametrize("quantization", ["None", "I8", "RotatedI8"])
def test_stored_clusters_prune_and_find(spark, tmp_path, quantization):
    """Clustered vectors: recall of 0.9 from under a quarter of the clusters, and only their folders are read."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16))
    x = centres[rng.integers(0, 40, 3000)] + 0.25 * rng.standard_normal((3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    schema = Schema((SchemaField("v", field_type="Json", index_vector=True),))
    i = Index.create(spark, f"file://{tmp_path}/v", schema, IndexMeta(quantization=quantization))
    i.index_documents(spark.createDataFrame([(k, json.dumps([float(c) for c in v])) for k, v in enumerate(x)], "id bigint, v string"), id_column="id")
    i.commit()
    medoids, nprobe = i._medoids(0)
    assert 50 < len(medoids) and nprobe < len(medoids) / 4
    hits = 0
    for k in range(0, 3000, 150):
        want = set(np.argsort(-(x @ x[k]), kind="stable")[:10].tolist())
        hits += len(want & {r.doc_id for r in i.search(query_vector=x[k].tolist(), mode="vector", ann_mode="Nprobe", with_documents=False).results.collect()})
    assert hits >= 0.9 * 200
    near = i._near(x[0].tolist(), False, "Nprobe", 3, None)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "cluster_id" in plan.split("PartitionFilters", 1)[1].split("PushedFilters", 1)[0]
    assert near.count() < 1500


def test_tokens_cut_from_bytes_are_those_of_the_expression(spark):
    from relquarry.operators import build

    rng = random.Random(5)
    texts = [None, ""] + ["".join(rng.choice("aZ-+# _9.\u00e9\u00c0\u00d6\u00d7\u00f7\u00b5\u00b2\u00aa\u00df\u00ff\n\u00a0" + "\u0130\u03a3\u2019\u4e2d\U0001f600" * (k % 3 == 0)) for _ in range(rng.randint(0, 40))) for k in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, t string")
    rows = build.field_rows(docs, Schema((SchemaField("t", index_lexical=True),)), META)
    want = {r.doc_id: r.w for r in docs.select("doc_id", analysis.tokens("t").alias("w")).collect()}
    for r in rows.collect():
        words, n = build.cut(pa.array([r.x0], pa.string()))
        assert n[0] == len(words) and words.to_pylist() + (r.t0 or []) == want[r.doc_id]


@pytest.mark.parametrize("block", [5, 1 << 20])
def test_blocks_of_postings_against_brute_force(spark, tmp_path, monkeypatch, block):
    """Two fields, n-grams and synonyms; no posting is shuffled, and completions are made when they are asked for."""
    from relquarry.operators import build

    monkeypatch.setattr(build, "BLOCK", block)
    monkeypatch.setattr(build, "GRAM_BLOCK", block)
    rng, words = random.Random(9), ["the", "of", "And", "car", "\u00c9t\u00e9", "bus", "\u4e2d", "x", "12"]
    rows = [tuple(" ".join(rng.choices(words, k=rng.randint(0, 9))) if rng.random() < 0.9 else None for _ in "ab") for _ in range(60)]
    schema = Schema((SchemaField("a", index_lexical=True, completion_source=True), SchemaField("b", index_lexical=True)))
    i = Index.create(spark, f"file://{tmp_path}/b", schema, IndexMeta(frequent_words=("the", "of"), ngram_indexing=1 | 2 | 8 | 64), [("car", "bus"), ("the of", "bus")], buckets=3)
    i.index_documents(spark.createDataFrame(rows, "a string, b string").repartition(2))
    i.commit()
    stored = {r.doc_id: (r.a, r.b) for r in i.documents().collect()}
    want, df, grams, total = {}, {}, {}, 0
    for d, texts in stored.items():
        for f, t in enumerate(texts):
            ts = (t or "").lower().split()
            total += len(ts)
            places = [(w, k) for k, w in enumerate(ts)] + [(" ".join(g), k) for k, g in Q.ngram_terms(ts, {"the", "of"}, 1 | 2 | 8 | 64)]
            places += [("bus", k) for w, k in places if w in ("car", "the of")]
            for w, k in set(places):
                want.setdefault((d, f, w), []).append(k)
                df.setdefault(w, set()).add(d)
            if f == 0:
                found = [w for w in ts if len(w) > 1 and not w.isdecimal()] + [" ".join(ts[k : k + 2]) for k in range(len(ts) - 1) if len(ts[k]) > 1] + [" ".join(ts[k : k + 3]) for k in range(len(ts) - 2) if len(ts[k + 1]) > 1]
                for g in found:
                    grams[g] = grams.get(g, 0) + 1
    got = i.relation("postings").collect()
    assert len(got) == len(want) and {(r.doc_id, r.field_id, r.term): r.positions for r in got} == {k: sorted(v) for k, v in want.items()}
    assert all(r.tf == len(r.positions) for r in got) and i.stats()[1] == total / 60
    assert {r.term: r.df for r in i.relation("terms").collect()} == {w: len(x) for w, x in df.items()}
    assert i.document_frequency(["the of", "bus", "none"]) == {w: len(df[w]) for w in ("the of", "bus")}
    rows = build.field_rows(i.documents(), schema, i.meta)
    assert "Exchange" not in build.write_postings(rows, f"file://{tmp_path}/c", i.meta, [], 3, 2)._jdf.queryExecution().executedPlan().toString()
    assert not (tmp_path / "b" / "completions").exists()
    assert sorted(map(tuple, i.completions().collect())) == sorted(grams.items())
    assert Index.open(spark, i.path).state["levels"][0]["relations"][-1] == "completions"


@pytest.mark.parametrize("piece", [7, 1 << 22])
def test_texts_go_through_python_by_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(analysis, "PIECE", piece)
    texts = [None, "", "\u00c4rger l'\u00e9t\u00e9. Next one! x", "a" * 50, None, "b c. d", "\u4e2d\u56fd"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    for made, want in (
        (analysis.by_pieces(analysis.folded_tokens, "array<string>"), analysis.folded_tokens),
        (analysis.by_pieces(analysis.fold, "string"), analysis.fold),
        (analysis.chunk_text_of(12), lambda t: analysis.chunks(t, 12)),
    ):
        assert [r[0] for r in docs.orderBy("i").select(made("t")).collect()] == [want(t) for t in texts]
    stem = stemmers.stemmer("english")
    lists = docs.orderBy("i").select(analysis.stemmed(analysis.tokens("t"), "english").alias("s"), analysis.tokens("t").alias("w")).collect()
    assert all(r.s == [stem(w) for w in r.w] for r in lists)
    sizes = [len(a) for a in analysis.by_pieces(analysis.fold, "string").func(iter([pa.array(texts, pa.string())]))]
    assert sum(sizes) == len(texts) and (len(sizes) > 3) == (piece == 7)


@pytest.mark.parametrize("rows,columns", [(3, 2), (16, 512), (2048, 512)])
def test_batch_search_by_blocks_against_brute_force(spark, monkeypatch, rows, columns):
    """Ties, documents of several vectors, fewer documents than k, and probed clusters."""
    monkeypatch.setattr(vector, "ROWS", rows)
    monkeypatch.setattr(vector, "COLUMNS", columns)
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (60, 4)).astype(float)
    for doc in (np.arange(60), np.arange(60) // 3, np.arange(60) % 4):
        table = [(int(d), v.tolist(), int(c)) for d, v, c in zip(doc, x, np.arange(60) % 5)]
        vectors = spark.createDataFrame(table, "doc_id bigint, vector array<float>, cluster_id int").repartition(3)
        queries = spark.createDataFrame([(10 + j, x[j].tolist()) for j in range(5)], "query_id bigint, query array<float>")
        for kind in ("Dot", "Euclidean"):
            for medoids, nprobe in ((None, 0), (x[:5], 2)):
                want = []
                for j in range(5):
                    best = {}
                    for d, v, c in table:
                        s = float(np.dot(v, x[j])) if kind == "Dot" else -float(((np.array(v) - x[j]) ** 2).sum())
                        if medoids is None or c in vector.probe(x[j], medoids, nprobe, None, kind):
                            best[d] = max(best.get(d, -1e9), s)
                    want += [(10 + j, d, s, r + 1) for r, (d, s) in enumerate(sorted(best.items(), key=lambda e: (-e[1], e[0]))[:6])]
                got = vector.search_many(vectors, queries, 6, kind, medoids, nprobe).collect()
                assert sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in got) == sorted(want)


def test_documents_without_words(spark, tmp_path):
    i = make(spark, tmp_path / "e", [(None,), ("...",)], META, Schema((SchemaField("body", index_lexical=True, completion_source=True, dictionary_source=True),)))
    i.commit()
    assert i.search("word").result_count_total == 0 and i.documents().count() == 2 and i.stats() == (2, 0.0) and i.dictionary() is None and i.completions() is None


def test_levels_merge_and_failures_leave_the_old_state(spark, tmp_path):
    i = Index.create(spark, f"file://{tmp_path}/m", Schema((SchemaField("t", index_lexical=True, completion_source=True),)), IndexMeta(ngram_indexing=0, auto_commit_docs=2, merge_levels=3), buckets=2)
    for k in range(9):
        i.index_documents(spark.createDataFrame([(f"word a{k}",), (f"word b{k}",)], "t string"))
    assert len(i.state["levels"]) <= 3 and all(x["committed"] for x in i.state["levels"])
    assert sorted(r.doc_id for r in i.documents().collect()) == list(range(18)) and i.stats()[0] == 18
    assert i.search("word", "union").result_count_total == 18 and i.document_frequency(["word"]) == {"word": 18}
    assert {r.gram: r.n for r in i.completions().where("gram = 'word'").collect()} == {"word": 18}
    folders = {p.name for p in (tmp_path / "m" / "docs").iterdir()}
    assert folders == {f"level={x['id']}" for x in i.state["levels"]}
    i.delete_by_query("a3")
    i.delete_by_query("word", length=2, offset=1)
    assert i.documents().count() == 15
    whole = {r.doc_id for r in i.documents().collect()}
    monkey = i._write_postings
    i._write_postings = lambda *a: (_ for _ in ()).throw(OSError("disk"))
    with pytest.raises(OSError):
        i.compact()
    i._write_postings = monkey
    again = Index.open(spark, f"file://{tmp_path}/m")
    assert {r.doc_id for r in again.documents().collect()} == whole
    again.compact()
    assert len(again.state["levels"]) == 1 and {r.doc_id for r in Index.open(spark, again.path).documents().collect()} == whole
    assert again.stats()[0] == 15 and again.state["deleted"] == 0
    assert again.index_documents(spark.createDataFrame([("later",)], "t string")) == 1 and again.state["next_doc"] == 19


def test_texts_are_chunked_and_embedded(spark, tmp_path):
    i = Index.create(spark, f"file://{tmp_path}/e", Schema((SchemaField("body", index_lexical=True, index_vector=True),)), IndexMeta(chunk_size=20, vector_similarity="Cosine", ngram_indexing=0))
    docs = spark.createDataFrame([("aaaa aaaa. bbbb bbbb bb. x",), ("cccc.",), (None,), ("hhhh hh. gg.",)], "body string")
    with pytest.raises(ValueError):
        i.index_documents(docs)
    i = Index.create(spark, f"file://{tmp_path}/e2", i.schema, i.meta)
    i.set_embedder(lambda texts: [[float(t.lower().count(c)) + 0.01 for c in "abcdefgh"] for t in texts])
    i.index_documents(docs)
    i.commit()
    assert i.vector_count() == 4
    best = lambda q: i.search(query_vector=q, mode="vector", length=1).results.first().doc_id
    assert [best("bb"), best("c"), best("hh h"), best("aa")] == [0, 1, 3, 0]


def test_settings_of_dictionaries_and_segmentation(spark, tmp_path):
    from relquarry.schema import QueryCompletion, SpellingCorrection

    meta = IndexMeta(tokenizer="UnicodeAlphanumericZH", zh_dictionary=(("\u4e2d\u56fd", 50.0), ("\u4eba", 20.0)), ngram_indexing=0, spelling_correction=SpellingCorrection(max_dictionary_entries=3), query_completion=QueryCompletion(max_completion_entries=2))
    i = Index.create(spark, f"file://{tmp_path}/z", Schema((SchemaField("t", index_lexical=True),)), meta, buckets=2)
    i.index_documents(spark.createDataFrame([("\u4e2d\u56fd\u4eba one",), ("\u4e2d\u56fd one two",), ("one two three",)], "t string"))
    i.commit()
    assert i.search("\u4e2d\u56fd").result_count_total == 2 and i.search("\u4eba").result_count_total == 1
    assert {r.term for r in i.dictionary().collect()} == {"\u4e2d\u56fd", "one", "two"}
    assert {r.gram for r in i.completions().collect()} == {"one"}  # those of two are more than the limit holds
    i.save_completions(f"file://{tmp_path}/c")
    j = Index.create(spark, f"file://{tmp_path}/j", i.schema, IndexMeta())
    assert {(r.gram, r.n) for r in j.load_completions(f"file://{tmp_path}/c").collect()} == {("one", 3)}
    assert Index.open(spark, i.path).meta == meta
