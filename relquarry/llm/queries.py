"""Registered queries of the training-data operators, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embed_dedup, html_extract, line_dedup, packing, sharding, simhash, token_output, toxicity, url_filter
from .common import shared_dir, table

URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf_dir, "documents")).select("doc_id", "line_no", "first_doc_id", "first_line_no", "kept")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, length=1024)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_output.write_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), folder, end_id=2)
    return token_output.read_tokens(spark, folder, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_html_extract, op3_toxicity, op4_decontamination, op5_simhash, op6_packing, op7_sharding, op8_embedding_dedup, op9_url_filter, op10_token_output)
}

_HOST = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'"
    for v, h, p in sorted(URL_RULES, key=lambda r: (-r[1].count("."), -len(r[2])))
)
#: The CRC-32 of each byte, and that of a text's UTF-8 bytes.
_CRC = [k for k in range(256)]
for _ in range(8):
    _CRC = [(x >> 1) ^ (0xEDB88320 if x & 1 else 0) for x in _CRC]
_CRC32 = f"""xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
                  lambda c, b: xor(c >> 8, list_extract({_CRC}::BIGINT[], (xor(c, b) & 255) + 1))), 4294967295)"""
ORACLE: dict[str, str] = {
    # pre: groups with the bytes up to their end; search: a step fills one shard at the middle capacity; cut: the eight shards at the capacity found
    "op7_sharding": f"""
        WITH RECURSIVE doc AS (SELECT doc_id, text, coalesce(strlen(text), 0) + 1 AS size, coalesce(CAST('0x' || left(md5(text), 15) AS BIGINT), 0) AS h FROM documents),
        sums AS (SELECT h, CAST(sum(size) AS BIGINT) AS s FROM doc GROUP BY h),
        pre AS (SELECT h, s, CAST(sum(s) OVER (ORDER BY h) AS BIGINT) AS e FROM sums),
        whole AS (SELECT max(e) AS total, greatest(max(s), (max(e) + 7) // 8) AS low FROM pre),
        search(lo, hi, k, pos) AS (
            SELECT low, total, 0, 0::BIGINT FROM whole
            UNION ALL
            SELECT CASE WHEN nxt < total AND k = 7 THEN mid + 1 ELSE lo END, CASE WHEN nxt >= total THEN mid ELSE hi END,
                   CASE WHEN nxt >= total OR k = 7 THEN 0 ELSE k + 1 END, CASE WHEN nxt >= total OR k = 7 THEN 0 ELSE nxt END
            FROM (SELECT lo, hi, k, (lo + hi) // 2 AS mid, (SELECT max(e) FROM pre WHERE e <= pos + (lo + hi) // 2) AS nxt FROM search WHERE lo < hi), whole),
        cut(k, pos) AS (
            SELECT 0, 0::BIGINT
            UNION ALL
            SELECT k + 1, (SELECT max(e) FROM pre WHERE e <= pos + (SELECT min(lo) FROM search WHERE lo >= hi)) FROM cut WHERE k < 7),
        placed AS (SELECT doc_id, size, CASE WHEN text IS NOT NULL THEN {_CRC32} END AS text_crc32, CAST((SELECT count(*) FROM cut WHERE k > 0 AND cut.pos <= pre.e - pre.s) AS INT) AS shard FROM doc JOIN pre USING (h))
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
               row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32 NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard
        FROM placed
    """,
    "op9_url_filter": f"""
        WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, {_HOST} AS host, regexp_replace(regexp_extract(rest, '^[^?#]*'), '^[^/]*', '') AS path FROM u),
        f AS (SELECT *, CASE {_FITS} END AS hit FROM p)
        SELECT page_id, host, path, split_part(hit, ' ', 2) AS rule, coalesce(split_part(hit, ' ', 1), 'allow') AS verdict FROM f
    """,
}
