"""A corpus pipeline of the training-text operators: each stage works on all rows that its predecessor kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions.durable import shared_folder
from offerlens.llm import bpe, line_spread, minhash_join, mixing, quality_knn, queries
from offerlens.llm.names import free_name


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality_knn.train(docs, queries.table(spark, sf_dir, "labels"), queries.learnable("row_id"))
    score = free_name(docs, "__score")
    return quality_knn.score(docs, model, name=score).filter(F.col(score) >= queries.LEAST_QUALITY).drop(score)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of any length that stand on many sources."""
    kept = line_spread.remove_boilerplate(docs, max_words=None, counts=False)
    return kept.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash_join.one_per_group(docs)


def balanced_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as it is taken."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids: doc_id, source, n_tokens, ids, and whether the ids decode to the text."""
    ranks = bpe.read_ranks(public_tokenizers.path(queries.RANK_FILE))
    encoded = bpe.encode(docs.select("doc_id", "source", "text"), ranks, public_tokenizers.PATTERN, decoded=True)
    return encoded.selectExpr("doc_id", "source", "n_tokens", "ids", "decoded = cast(coalesce(text, '') as binary) AS exact")


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_boilerplate),
    ("n-gram Jaccard join", distinct_documents),
    ("mixing sources", balanced_sources),
    ("byte-level BPE", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written as Parquet in the shared folder and read again by the next."""
    docs = queries.table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
