"""Registered queries of the engine, each with the SQL that gives the same rows.

Search queries run on an index that is built once for a session and folder, from whole
tables and whole texts. Ranked results have scores rounded to 6 places and end ties by
doc_id. ``k`` best results are the feature of those queries.
"""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analysis, geo, highlight
from ..functions import vectors as V
from ..functions.words import ENGLISH
from ..index import Index
from ..operators import build, facets, lexical, rewrite, vector
from ..schema import IndexMeta, Schema, SchemaField, SpellingCorrection
from ..sources import readers
from ..storage import prepare, scratch
from . import query as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
RX = analysis.TOKEN
_built: dict[tuple, Index] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- indexes

DOCUMENTS = Schema((SchemaField("text", index_lexical=True, longest=True, dictionary_source=True, completion_source=True), SchemaField("lang", field_type="String16", facet=True), SchemaField("source", field_type="String32", facet=True), SchemaField("n_chars", field_type="I64", facet=True)))
PARTS = Schema((SchemaField("p_name", index_lexical=True, boost=2.0), SchemaField("p_type", index_lexical=True), SchemaField("p_brand", field_type="String16", facet=True), SchemaField("p_size", field_type="I32", facet=True, index_lexical=True)))
PLAIN = IndexMeta(lexical_similarity="Bm25f", ngram_indexing=0)


def index_for(spark: SparkSession, sf_dir: str, which: str = "documents") -> Index:
    key = (spark.sparkContext.applicationId, sf_dir, which)
    if key not in _built:
        path = f"{scratch(spark)}/{which}-{crc32(sf_dir.encode()):08x}"
        if which == "documents":
            index = Index.create(spark, path, DOCUMENTS, PLAIN, buckets=8)
            index.index_documents(table(spark, sf_dir, "documents"), id_column="doc_id")
        elif which == "parts":
            index = Index.create(spark, path, PARTS, PLAIN, buckets=4)
            index.index_documents(table(spark, sf_dir, "part"), id_column="p_partkey")
        elif which == "ngrams":
            index = Index.create(spark, path, Schema((SchemaField("text", index_lexical=True),)), IndexMeta(lexical_similarity="Bm25fProximity", frequent_words=FREQUENT), buckets=8)
            index.index_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), id_column="doc_id")
        elif which == "synonyms":
            index = Index.create(spark, path, Schema((SchemaField("text", index_lexical=True),)), PLAIN, build.synonym_pairs(SYNONYMS), buckets=8)
            index.index_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), id_column="doc_id")
        else:  # committed and pending documents, and deletes
            index = Index.create(spark, path, DOCUMENTS, PLAIN, buckets=8)
            docs = table(spark, sf_dir, "documents")
            index.index_documents(docs.where("doc_id % 4 <> 3"), id_column="doc_id")
            index.commit()
            index.delete_documents(docs.where("doc_id % 7 = 0 and doc_id % 4 <> 3"))
            index.index_documents(docs.where("doc_id % 4 = 3"), id_column="doc_id")
            _built[key] = index
            return index
        index.commit()
        _built[key] = index
    return _built[key]


FREQUENT = ("the", "of", "and", "in", "to", "a", "is")
SYNONYMS = (("thing", "ertion"), ("that", "than"))

# -- SQL pieces

_LEN = "(CASE WHEN n < 32 THEN n ELSE 24 + (((n - 24) >> greatest(length(bin(n - 24)) - 4, 0)) << greatest(length(bin(n - 24)) - 4, 0)) END)"


def _postings(source: str = "documents", key: str = "doc_id", fields: tuple[tuple[str, float], ...] = (("text", 1.0),), where: str = "true") -> str:
    """CTEs tok (doc_id, f, term, pos, dl), stat (n, avgdl), post (doc_id, f, term, tf, dl)."""
    parts = " UNION ALL ".join(f"SELECT {key} AS doc_id, {i} AS f, regexp_extract_all(lower(CAST({c} AS VARCHAR)), '{RX}') AS ts FROM {source} WHERE {where}" for i, (c, _) in enumerate(fields))
    return f"""WITH raw AS ({parts}), sized AS (SELECT *, len(ts) AS n FROM raw WHERE len(ts) > 0),
    field AS (SELECT doc_id, f, ts, {_LEN} AS dl FROM sized),
    tok AS (SELECT doc_id, f, dl, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM field),
    stat AS (SELECT (SELECT count(*) FROM {source} WHERE {where}) AS n, (SELECT sum(dl) FROM field) / (SELECT count(*) FROM {source} WHERE {where}) AS avgdl),
    post AS (SELECT doc_id, f, term, count(*) AS tf, any_value(dl) AS dl FROM tok GROUP BY ALL)"""


def _in(terms) -> str:
    return "(" + ", ".join(f"'{t}'" for t in terms) + ")"


def _scored(terms, boosts: tuple[float, ...] = (1.0,)) -> str:
    boost = "1.0" if len(boosts) == 1 else "CASE f " + " ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(boosts)) + " END"
    return f"""df AS (SELECT term, count(DISTINCT doc_id) AS df FROM post WHERE term IN {_in(terms)} GROUP BY term),
    scored AS (SELECT doc_id, round(sum({boost} * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score, count(DISTINCT term) AS hits
               FROM post JOIN df USING (term), stat GROUP BY doc_id)"""


def _ranked(terms, cond: str = "true", k: int = 10, offset: int = 0, postings: str | None = None, boosts=(1.0,)) -> str:
    return f"{postings or _postings()}, {_scored(terms, boosts)} SELECT doc_id, score FROM scored WHERE {cond} ORDER BY score DESC, doc_id LIMIT {k} OFFSET {offset}"


def _without(terms) -> str:
    return f"doc_id NOT IN (SELECT doc_id FROM post WHERE term IN {_in(terms)})"


def _phrase(words, fields: str = "true") -> str:
    joins = " ".join(f"JOIN tok t{i} ON t{i}.doc_id = t0.doc_id AND t{i}.f = t0.f AND t{i}.pos = t0.pos + {i} AND t{i}.term = '{w}'" for i, w in enumerate(words) if i)
    return f"SELECT DISTINCT t0.doc_id FROM tok t0 {joins} WHERE t0.term = '{words[0]}' AND {fields.replace('f ', 't0.f ')}"


# -- text analysis


def _token_counts(tokenizer: str):
    def f(spark, sf_dir):
        docs = table(spark, sf_dir, "documents")
        return docs.select(F.explode(analysis.tokens("text", tokenizer)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))

    return f


_SPLIT = {
    "tok_ascii": ("AsciiAlphabetic", f"regexp_extract_all(translate(text, '{analysis.UPPER}', '{analysis.LOWER}'), '[a-z]+')"),
    "tok_unicode": ("UnicodeAlphanumeric", f"regexp_extract_all(lower(text), '{RX}')"),
    "tok_whitespace": ("Whitespace", r"list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')"),
    "tok_whitespace_lower": ("WhitespaceLowercase", rf"list_filter(regexp_split_to_array(translate(text, '{analysis.UPPER}', '{analysis.LOWER}'), '\s+'), lambda t: t <> '')"),
}
for _name, (_kind, _sql) in _SPLIT.items():
    query(f"SELECT term, count(*) AS n FROM (SELECT unnest({_sql}) AS term FROM documents) GROUP BY term", _name)(_token_counts(_kind))


@query()
def tok_folded(spark, sf_dir):
    return _token_counts("UnicodeAlphanumericFolded")(spark, sf_dir)


@query()
def fold_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", analysis.fold_text("text").alias("folded"))


@query()
def stem_en(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang = 'en'")
    return docs.select(F.explode(analysis.stemmed(analysis.tokens("text"), "english")).alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{RX}')) AS term FROM documents) WHERE term NOT IN {_in(ENGLISH)} GROUP BY term")
def stopword_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.explode(analysis.without(analysis.tokens("text"), "english")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"{_postings()} SELECT doc_id, dl FROM field")
def doc_len_quantized(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(analysis.tokens("text")).alias("n")).where("n > 0").select("doc_id", analysis.quantized_length(F.col("n")).cast("bigint").alias("dl"))


@query(f"{_postings()} SELECT term, count(DISTINCT doc_id) AS df FROM post GROUP BY term")
def term_df(spark, sf_dir):
    return index_for(spark, sf_dir).relation("terms").select("term", "df")


@query(f"{_postings()} SELECT n, round(avgdl, 6) AS avgdl FROM stat")
def corpus_stats(spark, sf_dir):
    n, avgdl = index_for(spark, sf_dir).stats()
    return spark.createDataFrame([(n, round(avgdl, 6))], "n bigint, avgdl double")


@query("SELECT event_id, trim(coalesce(props->>'$.k', '')) AS value FROM events")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("value"))


@query("SELECT event_id, array_to_string(list_transform(list_filter(json_keys(props), lambda k: json_type(props, '$.' || k) = 'VARCHAR'), lambda k: json_extract_string(props, '$.' || k)), ' ') AS text FROM events")
def json_values(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", analysis.json_text("props").alias("text"))


@query("SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type || ' end' AS text FROM part")
def json_nested(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    doc = F.to_json(F.struct("p_name", F.struct("p_size", F.array("p_brand", "p_type").alias("l")).alias("o"), F.lit("end").alias("z"), F.lit(True).alias("b")))
    return part.select("p_partkey", analysis.json_text(doc).alias("text"))


@query("SELECT p_partkey, base64(encode(p_name)) AS b64, substr(p_name, 3, 5) AS part, left(p_name, 6) AS head FROM part")
def text_utils(spark, sf_dir):
    c = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", analysis.encode_base64(c).alias("b64"), analysis.substring(c, 2, 5).alias("part"), analysis.truncate(c, 6).alias("head"))


@query()
def chunk_sentences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(analysis.chunk_text("text")).alias("chunk_no", "chunk"))


# -- matching and ranking


def _search(spark, sf_dir, text: str, kind: str = "union", k: int = 10, offset: int = 0, which: str = "documents", fields=()):
    index = index_for(spark, sf_dir, which)
    return lexical.rank(index.matches(Q.parse(text, index.meta, kind), fields=fields), k, offset)


def _count(spark, sf_dir, text: str, kind: str, which: str = "documents", fields=()):
    index = index_for(spark, sf_dir, which)
    return index.matches(Q.parse(text, index.meta, kind), fields=fields, score=False).agg(F.count("*").alias("n"))


@query(_ranked(["thing"]))
def bm25_single(spark, sf_dir):
    return _search(spark, sf_dir, "thing")


@query(
    f"{_postings()}, {_scored(['the', 'thing', 'ertion'])}, best AS (SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 10) SELECT doc_id, score, lang, source FROM best JOIN documents USING (doc_id)"
)
def bm25_union(spark, sf_dir):
    top = _search(spark, sf_dir, "the thing ertion")
    return top.join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id").select("doc_id", "score", "lang", "source")


@query(_ranked(["the", "thing"], "hits = 2"))
def bm25_intersection(spark, sf_dir):
    return _search(spark, sf_dir, "+the +thing")


@query(_ranked(["the", "and"], f"{_without(['thing', 'of'])}"))
def bm25_not(spark, sf_dir):
    return _search(spark, sf_dir, "the and -thing -of")


@query(_ranked(["the", "of"], k=15, offset=20))
def bm25_page_offset(spark, sf_dir):
    return _search(spark, sf_dir, "the of", k=15, offset=20)


_FIELDS = (("p_name", 2.0), ("p_type", 1.0), ("p_size", 1.0))
_PARTS = _postings("part", "p_partkey", _FIELDS)


@query(_ranked(["small", "ring", "7"], k=20, postings=_PARTS, boosts=(2.0, 1.0, 1.0)))
def bm25f_boost(spark, sf_dir):
    return _search(spark, sf_dir, "small ring 7", k=20, which="parts")


@query(f"{_PARTS} SELECT count(DISTINCT doc_id) AS n FROM post WHERE term = '7' AND f = 2")
def number_as_text(spark, sf_dir):
    return _count(spark, sf_dir, "7", "intersection", "parts", ("p_size",))


@query(_ranked(["small"], "doc_id IN (SELECT doc_id FROM post WHERE term = 'small' AND f = 1)", 20, postings=_PARTS, boosts=(2.0, 1.0, 1.0)))
def field_filter(spark, sf_dir):
    return _search(spark, sf_dir, "small", k=20, which="parts", fields=("p_type",))


@query(f"{_postings()} SELECT count(DISTINCT doc_id) AS n FROM post WHERE term IN {_in(['thing', 'ertion', 'der'])}")
def count_union(spark, sf_dir):
    return _count(spark, sf_dir, "thing ertion der", "union")


@query(f"{_postings()} SELECT count(*) AS n FROM (SELECT doc_id FROM post WHERE term IN ('the', 'thing') GROUP BY doc_id HAVING count(DISTINCT term) = 2)")
def count_intersection(spark, sf_dir):
    return _count(spark, sf_dir, "the thing", "intersection")


@query(f"{_postings()} SELECT count(*) AS n FROM ({_phrase(['of', 'the'])})")
def count_phrase(spark, sf_dir):
    return _count(spark, sf_dir, '"of the"', "phrase")


for _name, _words in {"phrase_bigram": ["of", "the"], "phrase_trigram": ["in", "of", "the"], "phrase_repeat_term": ["the", "of", "the"]}.items():
    query(_ranked(list(dict.fromkeys(_words)), f"doc_id IN ({_phrase(_words)})", 20), _name)(lambda spark, sf_dir, w=" ".join(_words): _search(spark, sf_dir, f'"{w}"', "phrase", 20))


@query(_ranked(["of", "the", "thing"], f"hits = 3 AND doc_id IN ({_phrase(['of', 'the'])}) AND {_without(['ertion'])}", 20))
def mixed_phrase_and(spark, sf_dir):
    return _search(spark, sf_dir, '"of the" thing -ertion', "union", 20)


@query(f"{_PARTS} SELECT doc_id FROM ({_phrase(['small', 'ring'], 'f = 0')})")
def phrase_field_filter(spark, sf_dir):
    index = index_for(spark, sf_dir, "parts")
    return index.matches(Q.parse('"small ring"', index.meta), fields=("p_name",)).select("doc_id")


_EMPTY = "SELECT doc_id, lang FROM documents ORDER BY doc_id {} LIMIT 10"


@query(_EMPTY.format("DESC"))
def empty_query_desc(spark, sf_dir):
    return index_for(spark, sf_dir).search("", enable_empty_query=True, result_type="Topk", return_fields=("lang",)).results


@query(_EMPTY.format("ASC"))
def empty_query_asc(spark, sf_dir):
    return index_for(spark, sf_dir).search("", enable_empty_query=True, result_type="Topk", return_fields=("lang",), sort=(facets.ResultSort("_id"),)).results


@query("SELECT doc_id, source FROM documents WHERE doc_id >= 50 ORDER BY doc_id LIMIT 12 OFFSET 5")
def iterator_forward(spark, sf_dir):
    return index_for(spark, sf_dir).iterate(50, 5, 12, fields=("source",))


@query("SELECT doc_id, source FROM documents WHERE doc_id <= 150 ORDER BY doc_id DESC LIMIT 12 OFFSET 5")
def iterator_backward(spark, sf_dir):
    return index_for(spark, sf_dir).iterate(150, 5, -12, fields=("source",))


@query("SELECT doc_id, text, lang FROM documents WHERE doc_id = 42")
def get_document(spark, sf_dir):
    return index_for(spark, sf_dir).get_document(42, ("text", "lang"))


@query("SELECT n_chars AS value FROM documents WHERE doc_id = 42")
def get_facet_value(spark, sf_dir):
    return index_for(spark, sf_dir).get_facet_value(42, "n_chars")


# -- facets, filters, sorting


@query(f"{_postings()} SELECT lang AS value, count(*) AS count FROM documents WHERE doc_id IN (SELECT doc_id FROM post WHERE term = 'thing') GROUP BY lang")
def facet_string(spark, sf_dir):
    index = index_for(spark, sf_dir)
    found = index.matches(Q.parse("thing", index.meta), score=False)
    return facets.string_facet(index.documents().join(found, "doc_id", "left_semi"), "lang")


@query("SELECT source AS value, count(*) AS count FROM documents WHERE starts_with(source, 'src1') GROUP BY source ORDER BY count DESC, value LIMIT 5")
def facet_string_prefix_len(spark, sf_dir):
    return facets.string_facet(table(spark, sf_dir, "documents"), "source", "src1", 5)


@query("SELECT 'lang' AS field, lang AS value, count(*) AS count FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def index_facets(spark, sf_dir):
    return index_for(spark, sf_dir).string_facets(["lang", "source"])


@query("SELECT 'p_size' AS field, CAST(min(p_size) AS DOUBLE) AS min, CAST(max(p_size) AS DOUBLE) AS max FROM part UNION ALL SELECT 'p_retailprice', min(p_retailprice), max(p_retailprice) FROM part")
def facet_minmax(spark, sf_dir):
    return facets.min_max(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"])


def _sets(spark, sf_dir):
    return table(spark, sf_dir, "part").withColumn("words", F.split("p_name", " "))


@query("SELECT value, count(*) AS count FROM (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS value FROM part) GROUP BY value")
def facet_stringset(spark, sf_dir):
    return facets.string_facet(_sets(spark, sf_dir), "words")


_RANGES = (("0-10", 0), ("10-20", 10), ("20-40", 20), ("40+", 40))
_BUCKET = "CASE WHEN l_quantity >= 40 THEN 3 WHEN l_quantity >= 20 THEN 2 WHEN l_quantity >= 10 THEN 1 WHEN l_quantity >= 0 THEN 0 END"
_COUNTED = f"WITH b AS (SELECT {_BUCKET} AS i, count(*) AS count FROM lineitem GROUP BY ALL) SELECT ['0-10', '10-20', '20-40', '40+'][i + 1] AS label, {{}} AS count FROM b WHERE i IS NOT NULL"
for _name, _type, _sum in (("within", "CountWithinRange", "count"), ("above", "CountAboveRange", "CAST(sum(count) OVER (ORDER BY i DESC) AS BIGINT)"), ("below", "CountBelowRange", "CAST(sum(count) OVER (ORDER BY i) AS BIGINT)")):
    query(_COUNTED.format(_sum), f"facet_range_{_name}")(lambda spark, sf_dir, t=_type: facets.range_facet(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), _RANGES, t))

_YEARS = tuple((str(y), int((y - 1970) * 365.25 * 86400)) for y in range(1990, 2030))


@query(
    "WITH y AS (SELECT year, CAST(floor((year - 1970) * 365.25 * 86400) AS BIGINT) AS low FROM range(1990, 2030) t(year)), "
    "o AS (SELECT CAST(epoch(o_orderdate) AS BIGINT) AS s FROM orders) "
    "SELECT CAST(year AS VARCHAR) AS label, count(*) AS count FROM o JOIN y ON s >= low AND s < low + 31557600 AND year = (SELECT max(z.year) FROM y z WHERE z.low <= s) GROUP BY year"
)
def facet_timestamp_years(spark, sf_dir):
    return facets.range_facet(table(spark, sf_dir, "orders"), F.unix_timestamp("o_orderdate"), _YEARS)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000")
def filter_range(spark, sf_dir):
    return facets.filtered(table(spark, sf_dir, "orders"), [facets.FacetFilter("o_totalprice", range=facets.Range(1000, 50000))]).select("o_orderkey", "o_totalprice")


@query("SELECT event_id FROM events WHERE CAST(floor(epoch(ts)) AS BIGINT) >= 1704067200 AND CAST(floor(epoch(ts)) AS BIGINT) < 1705276800")
def filter_timestamp(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("seconds", F.unix_timestamp("ts"))
    return facets.filtered(ev, [facets.FacetFilter("seconds", range=facets.Range(1704067200, 1705276800))]).select("event_id")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error')")
def filter_string(spark, sf_dir):
    return facets.filtered(table(spark, sf_dir, "events"), [facets.FacetFilter("event_type", ("click", "error"))]).select("event_id", "event_type")


@query("SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['ring', 'bolt'])")
def filter_stringset(spark, sf_dir):
    return facets.filtered(_sets(spark, sf_dir), [facets.FacetFilter("words", ("ring", "bolt"))]).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND source IN ('src1', 'src2', 'src3') AND n_chars >= 200 AND n_chars < 5000")
def filter_combo(spark, sf_dir):
    f = [facets.FacetFilter("lang", ("en", "fr")), facets.FacetFilter("source", ("src1", "src2", "src3")), facets.FacetFilter("n_chars", range=facets.Range(200, 5000))]
    return facets.filtered(index_for(spark, sf_dir).documents(), f).select("doc_id")


@query(f"{_postings()}, {_scored(['the', 'thing'])} SELECT doc_id, score FROM scored JOIN documents USING (doc_id) WHERE hits = 2 AND lang = 'en' AND n_chars >= 1000 AND n_chars < 9000 ORDER BY score DESC, doc_id LIMIT 10")
def search_filtered(spark, sf_dir):
    f = (facets.FacetFilter("lang", ("en",)), facets.FacetFilter("n_chars", range=facets.Range(1000, 9000)))
    return index_for(spark, sf_dir).search("the thing", filters=f, result_type="Topk", return_fields=("doc_id",)).results.select("doc_id", "score")


@query("SELECT o_orderkey AS doc_id, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 25")
def sort_multi(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderpriority", "o_totalprice")
    return facets.top(o, [facets.ResultSort("o_orderpriority"), facets.ResultSort("o_totalprice", "descending")], 25)


@query(f"{_postings()}, {_scored(['the'])} SELECT doc_id, score, n_chars FROM scored JOIN documents USING (doc_id) ORDER BY score DESC, n_chars, doc_id LIMIT 25")
def sort_score_then_field(spark, sf_dir):
    index = index_for(spark, sf_dir)
    found = index.matches(Q.parse("the", index.meta)).withColumn("score", F.round("score", 6))
    return facets.top(found.join(index.documents().select("doc_id", "n_chars"), "doc_id"), [facets.ResultSort("_score", "descending"), facets.ResultSort("n_chars")], 25)


# -- geography: points derived from keys

_BASE = (12.5, 30.25)
_POINTS = "WITH p AS (SELECT c_custkey AS doc_id, CAST(c_custkey % 181 - 90 AS DOUBLE) AS lat, CAST(c_custkey * 7 % 361 - 180 AS DOUBLE) AS lon FROM customer), d AS (SELECT *, " + geo.distance_sql("lat", "lon", _BASE) + " AS far FROM p)"


def _points(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.struct((k % 181 - 90).cast("double").alias("lat"), (k * 7 % 361 - 180).cast("double").alias("lon")).alias("point"))


@query(f"{_POINTS} SELECT doc_id, round(far, 6) AS distance FROM d")
def geo_distance(spark, sf_dir):
    return _points(spark, sf_dir).select("doc_id", F.round(geo.distance(F.col("point.lat"), F.col("point.lon"), _BASE), 6).alias("distance"))


@query(f"{_POINTS} SELECT doc_id FROM d WHERE far >= 100 AND far < 2500")
def geo_filter(spark, sf_dir):
    return facets.filtered(_points(spark, sf_dir), [facets.FacetFilter("point", distance=facets.Distance(_BASE, 100, 2500))]).select("doc_id")


@query(f"{_POINTS} SELECT CASE WHEN far >= 8000 THEN 'far' WHEN far >= 3000 THEN 'middle' ELSE 'near' END AS label, count(*) AS count FROM d GROUP BY ALL")
def geo_facet(spark, sf_dir):
    return facets.facet(_points(spark, sf_dir), facets.QueryFacet("point", ranges=(("near", 0.0), ("middle", 3000.0), ("far", 8000.0)), base=_BASE))


@query(f"{_POINTS} SELECT doc_id, lat, lon FROM d ORDER BY round(far, 6), doc_id LIMIT 20")
def geo_sort(spark, sf_dir):
    p = _points(spark, sf_dir).withColumn("far", F.round(geo.distance(F.col("point.lat"), F.col("point.lon"), _BASE), 6))
    return facets.top(p, [facets.ResultSort("far")], 20).select("doc_id", "point.lat", "point.lon")


def _morton_sql(c: str) -> str:
    """Bits of a coordinate in units of 1e-7 degrees, each followed by a free one."""
    x = f"(CAST(trunc({c} * 1e7) AS BIGINT) & 4294967295)"
    parts = [f"(SELECT {x}::HUGEINT AS v)"]
    for shift, mask in geo._SPREAD:
        parts.append(f"(SELECT ((v | (v << {shift})) & {mask}::HUGEINT) AS v FROM {parts[-1]})")
    return f"(SELECT v FROM {parts[-1]})"


@query(f"{_POINTS}, m AS (SELECT doc_id, {_morton_sql('lat')} | ({_morton_sql('lon')} << 1) AS code FROM p) SELECT doc_id, CAST(CASE WHEN code >= 9223372036854775808 THEN code - 18446744073709551616 ELSE code END AS BIGINT) AS code FROM m")
def geo_morton(spark, sf_dir):
    return _points(spark, sf_dir).select("doc_id", geo.morton(F.col("point.lat"), F.col("point.lon")).alias("code"))


# -- deletes, updates, real time


@query("WITH m AS (SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(lower(text), '" + RX + "'), 'thing')) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM m)")
def delete_by_query(spark, sf_dir):
    index = _fresh(spark, sf_dir, "delete", Schema((SchemaField("text", index_lexical=True),)))
    index.index_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), id_column="doc_id")
    index.commit()
    index.delete_by_query("thing")
    return index.documents().select("doc_id")


def _fresh(spark, sf_dir, name: str, schema: Schema, meta: IndexMeta = PLAIN, buckets: int = 8) -> Index:
    index = Index.create(spark, f"{scratch(spark)}/{name}-{crc32(sf_dir.encode()):08x}", schema, meta, buckets=buckets)
    index.clear()
    return index


@query("WITH m AS (SELECT max(doc_id) AS top FROM documents) SELECT doc_id, lang FROM documents WHERE doc_id % 10 <> 3 UNION ALL SELECT top + row_number() OVER (ORDER BY doc_id), 'new' FROM documents, m WHERE doc_id % 10 = 3")
def update_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    index = Index.create(spark, f"{scratch(spark)}/update-{crc32(sf_dir.encode()):08x}", Schema((SchemaField("lang", field_type="String16", facet=True),)), PLAIN)
    index.clear()
    index.index_documents(docs, id_column="doc_id")
    old = docs.where("doc_id % 10 = 3")
    index.update_documents(old, old.select(F.lit("new").alias("lang")))
    index.commit()
    return index.documents().select("doc_id", "lang")


_LIVE = "doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 7 = 0 AND doc_id % 4 <> 3)"


@query(_ranked(["the", "thing"], _LIVE, 25))
def realtime_union(spark, sf_dir):
    index = index_for(spark, sf_dir, "live")
    return lexical.rank(index.matches(Q.parse("the thing", index.meta, "union"), realtime=True), 25)


@query(_ranked(["the", "thing"], _LIVE, 25, postings=_postings(where="doc_id % 4 <> 3")))
def committed_only(spark, sf_dir):
    index = index_for(spark, sf_dir, "live")
    return lexical.rank(index.matches(Q.parse("the thing", index.meta, "union")), 25)


@query(
    f"""{_postings(where="doc_id % 4 <> 3")} SELECT 'index' AS name, (SELECT max(doc_id) + 1 FROM documents) AS next_doc_id, (SELECT count(*) FROM documents WHERE doc_id % 4 = 3) AS uncommitted_docs, n AS committed_docs,
    (SELECT count(*) FROM documents) - (SELECT count(*) FROM documents WHERE doc_id % 7 = 0 AND doc_id % 4 <> 3) AS current_docs, (SELECT count(*) FROM documents WHERE doc_id % 7 = 0 AND doc_id % 4 <> 3) AS deleted_docs,
    2 AS levels, 3 AS facets, round(avgdl, 6) AS average_length, 0 AS vectors FROM stat"""
)
def index_info(spark, sf_dir):
    return index_for(spark, sf_dir, "live").info()


# -- vectors

_QUERY = "(SELECT embedding FROM embeddings WHERE vec_id = 7)"
_NEAR = "SELECT vec_id AS doc_id, round({0}, 6) AS score FROM embeddings ORDER BY score DESC, doc_id LIMIT 10"
_DOUBLES = "CAST(embedding AS DOUBLE[])"
_VEC_SQL = {"Dot": f"list_dot_product({_DOUBLES}, CAST({_QUERY} AS DOUBLE[]))", "Cosine": f"list_cosine_similarity({_DOUBLES}, CAST({_QUERY} AS DOUBLE[]))", "Euclidean": f"-(list_distance({_DOUBLES}, CAST({_QUERY} AS DOUBLE[])) ** 2)"}


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def _query_vector(spark, sf_dir) -> list[float]:
    return _vectors(spark, sf_dir).where("doc_id = 7").first()["vector"]


for _name, _kind in (("vec_dot", "Dot"), ("vec_cosine", "Cosine"), ("vec_euclid", "Euclidean")):
    query(_NEAR.format(_VEC_SQL[_kind]), _name)(lambda spark, sf_dir, k=_kind: lexical.rank(vector.exact(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), k), 10))


@query(f"SELECT vec_id AS doc_id, round({_VEC_SQL['Dot']}, 6) AS score FROM embeddings WHERE ({_VEC_SQL['Dot']} + 1) / 2 >= 0.6")
def vec_threshold(spark, sf_dir):
    found = vector.exact(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), "Dot", 0.6)
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id // 4 AS doc_id, round(max({_VEC_SQL['Dot']}), 6) AS score FROM embeddings GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 10")
def vec_multi_chunk(spark, sf_dir):
    chunks = _vectors(spark, sf_dir).withColumn("doc_id", F.floor(F.col("doc_id") / 4))
    return lexical.rank(vector.exact(chunks, _query_vector(spark, sf_dir)), 10)


_I8 = "list_transform({0}, lambda x: CAST(round(CAST(x AS DOUBLE) * 127) AS BIGINT))"


@query(f"SELECT vec_id AS doc_id, CAST(list_dot_product(CAST({_I8.format('embedding')} AS DOUBLE[]), CAST({_I8.format(_QUERY)} AS DOUBLE[])) AS BIGINT) AS score FROM embeddings ORDER BY score DESC, doc_id LIMIT 10")
def vec_i8_cosine(spark, sf_dir):
    q = V.quantize_cosine(V.literal(_query_vector(spark, sf_dir)))
    scored = _vectors(spark, sf_dir).select("doc_id", V.dot(V.quantize_cosine(F.col("vector")), q).cast("bigint").alias("score"))
    return scored.orderBy(F.col("score").desc(), "doc_id").limit(10)


@query(f"SELECT vec_id AS doc_id, round(({_VEC_SQL['Dot']} + 1) / 2, 6) AS score FROM embeddings")
def vec_reported_score(spark, sf_dir):
    found = vector.exact(_vectors(spark, sf_dir), _query_vector(spark, sf_dir))
    return found.select("doc_id", F.round(V.reported(F.col("score"), "Dot"), 6).alias("score"))


@query()
def vec_rotated_i8(spark, sf_dir):
    return _vectors(spark, sf_dir).select("doc_id", V.quantize_rotated()("vector").alias("q")).select("doc_id", F.round("q.scale", 9).alias("scale"), "q.values")


_RANGE = "SELECT min(list_min(embedding))::DOUBLE AS low, max(list_max(embedding))::DOUBLE AS high FROM embeddings"


@query(f"WITH r AS ({_RANGE}), s AS (SELECT low, ((1 << CAST(greatest(1, ceil(log2(high - low + 1))) AS INT)) - 1) / 255.0::DOUBLE AS step FROM r) SELECT vec_id AS doc_id, list_transform(embedding, lambda x: CAST(least(greatest(round((x::DOUBLE - low) / step), 0), 255) AS SMALLINT)) AS values FROM embeddings, s")
def vec_affine_i8(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    low, high = v.select(F.min(F.array_min("vector")), F.max(F.array_max("vector"))).first()
    step, zero = V.affine_range(low, high)
    return v.select("doc_id", V.quantize_affine(F.col("vector"), step, zero).alias("values"))


def _vector_index(spark, sf_dir, quantization: str = "None") -> Index:
    key = (spark.sparkContext.applicationId, sf_dir, "vectors", quantization)
    if key not in _built:
        index = _fresh(spark, sf_dir, f"vectors-{quantization}", Schema((SchemaField("embedding", field_type="Json", store=False, index_vector=True),)), IndexMeta(quantization=quantization))
        index.index_documents(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.to_json("embedding").alias("embedding")), id_column="doc_id")
        index.commit()
        _built[key] = index
    return _built[key]


@query()
def vec_ivf_nprobe(spark, sf_dir):
    """Ten nearest in the clusters that the index probes by itself: stored clusters, of which a scan reads those alone."""
    return lexical.rank(_vector_index(spark, sf_dir)._near(_query_vector(spark, sf_dir), False, "Nprobe", None, None), 10)


@query(_NEAR.format(_VEC_SQL["Dot"]))
def vec_index_exact(spark, sf_dir):
    return _vector_index(spark, sf_dir).search(query_vector=_query_vector(spark, sf_dir), mode="vector", with_documents=False).results


@query()
def vec_index_i8(spark, sf_dir):
    return lexical.rank(_vector_index(spark, sf_dir, "I8")._near(_query_vector(spark, sf_dir), False, "All", None, None), 10)


@query()
def recall_at_10(spark, sf_dir):
    """Recall of the index's own probe setting, over a stated query set."""
    v, index = _vectors(spark, sf_dir), _vector_index(spark, sf_dir)
    queries = v.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("vector").alias("query"))
    truth = vector.search_many(v, queries, 10)
    medoids, nprobe = index._medoids(index.state["levels"][0]["id"])
    found = vector.search_many(index.relation("vectors"), queries, 10, medoids=medoids, nprobe=nprobe)
    return vector.recall(found, truth)


@query("WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS doc_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10")
def vec_batch_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return vector.search_many(v, v.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("vector").alias("query")), 10).withColumn("rank", F.col("rank").cast("bigint"))


_LISTS = f"{_postings()}, {_scored(['the', 'thing'])}, l AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM (SELECT * FROM scored ORDER BY score DESC, doc_id LIMIT 20)), v AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({_NEAR.format(_VEC_SQL['Dot']).replace('LIMIT 10', 'LIMIT 20')}))"


@query(f"{_LISTS} SELECT doc_id, round(sum(1.0::DOUBLE / (0.6::DOUBLE + r - 1)), 6) AS score FROM (SELECT * FROM l UNION ALL SELECT * FROM v) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20")
def hybrid_rrf(spark, sf_dir):
    lex = _search(spark, sf_dir, "the thing", k=20)
    near = lexical.rank(vector.exact(_vectors(spark, sf_dir), _query_vector(spark, sf_dir)), 20)
    return lexical.rank(vector.reciprocal_rank_fusion(lex, near), 20)


# -- synonyms, n-grams, dictionaries, suggestions, highlighting


@query(f"{_postings()} SELECT DISTINCT doc_id FROM post WHERE term IN ('thing', 'ertion')")
def synonyms_multiway(spark, sf_dir):
    index = index_for(spark, sf_dir, "synonyms")
    return index.matches(Q.parse("thing", index.meta), score=False).select("doc_id")


@query(f"{_postings()} SELECT doc_id, f AS field_id, term, count(DISTINCT pos) AS tf FROM (SELECT doc_id, f, CASE WHEN k = 1 THEN 'than' ELSE term END AS term, pos FROM tok, (VALUES (0), (1)) x(k) WHERE term = 'that' OR (term = 'than' AND k = 0)) GROUP BY ALL")
def synonyms_oneway(spark, sf_dir):
    index = index_for(spark, sf_dir)
    pairs = spark.createDataFrame(build.synonym_pairs([("that", "than")], multiway=False), "term string, synonym string")
    rows = build.with_synonyms(index.relation("postings").where(F.col("term").isin("that", "than")), pairs)
    return rows.select("doc_id", F.col("field_id").cast("int"), "term", F.col("tf").cast("bigint"))


@query(f"{_postings()} SELECT a.term || ' ' || b.term AS term, count(DISTINCT a.doc_id) AS df FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term IN {_in(FREQUENT)} AND b.term IN {_in(FREQUENT)} GROUP BY ALL")
def ngram_ff(spark, sf_dir):
    terms = index_for(spark, sf_dir, "ngrams").relation("terms").where(F.size(F.split("term", " ")) == 2)
    return terms.select("term", "df")


_NGRAM = f"""{_postings()}, g AS (SELECT a.doc_id, count(*) AS tf, any_value(a.dl) AS dl FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.doc_id), d AS (SELECT count(*) AS df FROM g)
SELECT doc_id, round(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM g, d, stat ORDER BY score DESC, doc_id LIMIT 20"""


@query(_NGRAM)
def ngram_proximity(spark, sf_dir):
    return _search(spark, sf_dir, '"of the"', "phrase", 20, which="ngrams")


_GRAMS = f"""{_postings()} SELECT gram, count(*) AS n FROM (
  SELECT term AS gram FROM tok WHERE length(term) > 1 AND NOT regexp_full_match(term, '\\p{{Nd}}+')
  UNION ALL SELECT a.term || ' ' || b.term FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE length(a.term) > 1
  UNION ALL SELECT a.term || ' ' || b.term || ' ' || c.term FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN tok c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2 WHERE length(b.term) > 1) GROUP BY gram"""


@query(_GRAMS)
def completion_ngrams(spark, sf_dir):
    return index_for(spark, sf_dir).completions()


@query(f"SELECT gram AS completion, n FROM ({_GRAMS}) WHERE starts_with(gram, 'of th') ORDER BY n DESC, gram LIMIT 10")
def completion_lookup(spark, sf_dir):
    return rewrite.complete(index_for(spark, sf_dir).completions(), ["of", "th"])


@query(f"{_postings()} SELECT term, count(DISTINCT doc_id) AS df FROM post GROUP BY term")
def dictionary(spark, sf_dir):
    return index_for(spark, sf_dir).dictionary()


_TYPOS = ("thnig", "teh", "ertoin")


@query(f"{_postings()}, d AS (SELECT term, count(DISTINCT doc_id) AS df FROM post GROUP BY term) SELECT word, term, CAST(damerau_levenshtein(word, regexp_replace(term, '[^\\x00-\\x7F]', '~', 'g')) AS INTEGER) AS distance, df FROM d, (VALUES {', '.join(f'($${w}$$)' for w in _TYPOS)}) w(word) WHERE damerau_levenshtein(word, regexp_replace(term, '[^\\x00-\\x7F]', '~', 'g')) <= 1")
def spell_lookup(spark, sf_dir):
    return rewrite.near_terms(index_for(spark, sf_dir).dictionary(), list(_TYPOS), 1).select("word", "term", "distance", "df")


@query()
def spell_correct(spark, sf_dir):
    words = rewrite.correct(index_for(spark, sf_dir).dictionary(), ["of", "teh", "thnig"], SpellingCorrection(count_threshold=5))
    return spark.createDataFrame([(i, w) for i, w in enumerate(words)], "position int, word string")


@query()
def highlight_markup(spark, sf_dir):
    index = index_for(spark, sf_dir)
    return index.search("+thing", result_type="Topk", return_fields=("lang",), highlights=(highlight.Highlight("text", "marked", highlight_markup=True),)).results


@query()
def highlight_kwic(spark, sf_dir):
    index = index_for(spark, sf_dir)
    return index.search("the thing", "union", result_type="Topk", return_fields=("lang",), highlights=(highlight.Highlight("text", "kwic", 2, 160, True),)).results


# -- ingest, levels, result types


_PART = Schema((SchemaField("p_partkey", field_type="I64"), SchemaField("p_name"), SchemaField("p_size", field_type="I32"), SchemaField("p_retailprice", field_type="F64")))
_PART_SQL = "SELECT p_partkey, p_name, p_size, p_retailprice FROM part"


def _file(spark, sf_dir, name: str) -> str:
    return f"{scratch(spark)}/{name}-{crc32(sf_dir.encode()):08x}"


@query(_PART_SQL)
def ingest_json_lines(spark, sf_dir):
    path = _file(spark, sf_dir, "part-json")
    table(spark, sf_dir, "part").write.mode("overwrite").json(path)
    return readers.read_json(spark, path, _PART)


@query(_PART_SQL)
def ingest_json_array(spark, sf_dir):
    """Files that each hold an array of documents."""
    path = _file(spark, sf_dir, "part-array")
    part = table(spark, sf_dir, "part").select(F.pmod("p_partkey", F.lit(8)).alias("k"), F.to_json(F.struct("p_partkey", "p_name", "p_size", "p_retailprice")).alias("d"))
    part.groupBy("k").agg(F.concat(F.lit("["), F.array_join(F.collect_list("d"), ","), F.lit("]")).alias("value")).select("value").repartition(8).write.mode("overwrite").text(path)
    return readers.read_json(spark, path, _PART)


for _kind, _sign in {"csv": ",", "ssv": ";", "tsv": "\t", "psv": "|"}.items():

    @query(_PART_SQL, f"ingest_{_kind}")
    def _ingest(spark, sf_dir, kind=_kind, sign=_sign):
        path = f"{_file(spark, sf_dir, 'part')}.{kind}"
        table(spark, sf_dir, "part").select(*[f.field for f in _PART.fields]).write.mode("overwrite").option("sep", sign).option("escape", '"').csv(path)
        return readers.read_csv(spark, path, _PART)


@query("SELECT vec_id AS id, embedding AS vector FROM embeddings")
def ingest_fvecs(spark, sf_dir):
    """Files of float vectors, one a partition of ascending ids."""
    path = _file(spark, sf_dir, "fvecs")
    readers.write_fvecs(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), path)
    return readers.read_fvecs(spark, path)


@query("SELECT p_partkey, p_size FROM part")
def file_store(spark, sf_dir):
    """Original files, listed and read as bytes."""
    path = _file(spark, sf_dir, "files")
    table(spark, sf_dir, "part").select("p_partkey", "p_size").write.mode("overwrite").json(path)
    rows = readers.read_files(spark, path, "*.json").select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where("line <> ''")
    return rows.select(F.from_json("line", "p_partkey bigint, p_size int").alias("d")).select("d.*")


_TEXT = Schema((SchemaField("text", index_lexical=True),))


@query(_ranked(["the", "thing"], k=20))
def merged_levels(spark, sf_dir):
    """Eight batches, each committed by itself, of which merges make few levels: the same rows as from one."""
    index = _fresh(spark, sf_dir, "merged", _TEXT, IndexMeta(lexical_similarity="Bm25f", ngram_indexing=0, auto_commit_docs=1, merge_levels=4), 4)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    for k in range(8):
        index.index_documents(docs.where(F.pmod("doc_id", F.lit(8)) == k), id_column="doc_id")
    return lexical.rank(index.matches(Q.parse("the thing", index.meta, "union")), 20)


@query(_ranked(["the", "thing"], "doc_id % 5 <> 0", 20, postings=_postings(where="doc_id % 5 <> 0")))
def compacted(spark, sf_dir):
    """Statistics follow the documents that are left."""
    index = _fresh(spark, sf_dir, "compacted", _TEXT, PLAIN, 4)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    for k in range(2):
        index.index_documents(docs.where(F.pmod("doc_id", F.lit(2)) == k), id_column="doc_id")
    index.delete_documents(docs.where("doc_id % 5 = 0"))
    index.compact()
    return lexical.rank(index.matches(Q.parse("the thing", index.meta, "union")), 20)


@query("SELECT doc_id, lang FROM documents")
def stream_ingest(spark, sf_dir):
    """A stream of files, committed batch by batch."""
    from uuid import uuid4

    from ..streaming import ingest

    schema = Schema((SchemaField("own_id", field_type="I64"), SchemaField("lang", field_type="String16", facet=True)))
    index, folder = _fresh(spark, sf_dir, "stream", schema), _file(spark, sf_dir, "stream-files")
    table(spark, sf_dir, "documents").select(F.col("doc_id").alias("own_id"), "lang").repartition(4).write.mode("overwrite").parquet(folder)
    wait = ingest.stream_into(index, ingest.read_stream(spark, folder, schema, files_per_trigger=2), f"{folder}-{uuid4().hex}")
    wait.awaitTermination()
    return index.documents().select(F.col("own_id").alias("doc_id"), "lang")


@query(f"{_postings()} SELECT count(*) AS n FROM (SELECT doc_id FROM post WHERE term IN ('the', 'thing') GROUP BY doc_id HAVING count(DISTINCT term) = 2)")
def result_count(spark, sf_dir):
    """A search of length 0 gives the count alone."""
    found = index_for(spark, sf_dir).search("the thing", length=0)
    return spark.createDataFrame([(found.result_count_total,)], "n bigint")


@query(f"{_postings()} SELECT term, count(DISTINCT doc_id) AS df FROM post GROUP BY term")
def dictionary_csv(spark, sf_dir):
    """The dictionary saved as CSV and loaded by an index without documents."""
    path = _file(spark, sf_dir, "dictionary-csv")
    index_for(spark, sf_dir).save_dictionary(path)
    return _fresh(spark, sf_dir, "loaded", _TEXT).load_dictionary(path)


@query(f"{_postings()}, w AS (SELECT term, count(DISTINCT doc_id) AS df FROM post WHERE term IN {_in(['thing', 'the', 'of', 'nosuchterm'])} GROUP BY term) SELECT term, df FROM w")
def query_terms_df(spark, sf_dir):
    """Frequencies of a query's terms, from their buckets alone."""
    df = index_for(spark, sf_dir).document_frequency(["thing", "the", "of", "nosuchterm"])
    return spark.createDataFrame(sorted(df.items()), "term string, df bigint")


@query("SELECT count(*) AS n FROM documents WHERE lang = 'de'")
def clear_and_reindex(spark, sf_dir):
    """What was there before clear() is gone; the schema stays."""
    index = _fresh(spark, sf_dir, "cleared", Schema((SchemaField("lang", field_type="String16", facet=True),)))
    docs = table(spark, sf_dir, "documents").select("lang")
    index.index_documents(docs)
    index.commit()
    index.clear()
    index.index_documents(docs.where("lang = 'de'"))
    index.close()
    return Index.open(spark, index.path).documents().agg(F.count("*").alias("n"))
