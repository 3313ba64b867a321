"""A corpus pipeline in five stages, each on all that the one before has kept.

1. language: documents of unknown language go, which are those without a letter. LEAST_SCORE hardly rejects more: the best
   language's score is never under one over the number of languages.
2. exact_dedup: of equal texts the row with the largest doc_id stays.
3. near_dedup: of documents linked by five-word shingles of a similarity of 0.8 or more the one with the smallest doc_id stays.
4. mixing: sources are mixed to target weights, whole documents, some used twice.
5. tokens: every text is encoded and decoded by byte-level BPE; one row of digests per use.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, with the columns of documents up to the last one. Null
ids, texts and sources, repeated rows, empty tables and extra columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnmill.llm import crf, mixing, quotient, similar
from turnmill.llm.arrays import free_names, small_batches
from turnmill.llm.queries import tokenized
from turnmill.session import run_folder

LEAST_SCORE = 0.3
SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 6


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found, = free_names(docs, "found")
    marked = docs.withColumn(found, crf.languages(docs, crf.learn(docs)))
    return marked.filter((F.col(f"{found}.lang_pred") != crf.UNKNOWN) & (F.col(f"{found}.score") >= LEAST_SCORE)).drop(found)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quotient.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return similar.keep_one(docs, width=SHINGLE, least=SIMILARITY, radius=RADIUS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return tokenized(docs)


STAGES = [("language", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mix_sources), ("tokens", tokens)]

#: A conditional random field and SimHash components cannot be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{run_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
