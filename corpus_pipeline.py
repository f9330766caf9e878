"""A corpus pipeline of five stages over the documents table: quality, near duplicates, leaks, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

Every stage judges rows by their own text. Null and repeated doc_ids, null and empty texts, repeated rows and texts of any
length are rows like others; other columns, whatever their names, are carried along. No documents, labels or benchmark
items give a stage nothing to drop: without labels every document has the score 0.5 and stays, without items none leaks.
Of equal documents the smallest doc_id stays (null is the largest), of rows of one doc_id and class one; the mix of no words is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import common, decontaminate, mixing, ngram_join, quality, token_output


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rule ensemble accepts."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each class of near copies."""
    return ngram_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights; a document comes as often as it is drawn, at most three times."""
    return mixing.mix(docs).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document of the mix, read back from the token files."""
    return token_output.op8_token_output(spark, sf_dir, docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

#: A fitted model, MinHash and seeded draws are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote for itself is deleted when its result is written, and the results of
    stages when the last is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with common.workspace(spark) as keep_last:
        for _, stage in STAGES:
            with common.workspace(spark) as keep:
                docs = keep(common.cut(stage(spark, docs, sf_dir)))
        return keep_last(docs)
