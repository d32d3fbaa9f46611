"""A pipeline from raw documents to packed sequences.

Each stage is (name, function of (spark, docs, sf_dir)); what a stage returns is written
as Parquet and read again as the next one's documents. Null text: kept by every stage, as
a document without content. Stages that drop documents: toxicity (predicted toxic),
near-duplicates (all but the smallest doc_id of a class), decontamination (coverage of a
benchmark item at the threshold). Line dedup edits texts and keeps every document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquarry.llm import decontam, line_dedup, packing, simhash, toxicity
from relquarry.llm.common import shared_dir, table
from relquarry.llm.queries import vocabulary


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(docs)


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=0, length=1024)


STAGES = [
    ("toxicity", stage_toxicity),
    ("line_dedup", stage_line_dedup),
    ("simhash_dedup", stage_simhash),
    ("decontamination", stage_decontamination),
    ("packing", stage_packing),
]

#: SQL can express neither the learned scores nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs.select([F.col(c) for c in docs.columns])
