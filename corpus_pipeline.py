"""The corpus pipeline: documents in, sharded training documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes each stage's rows as Parquet in the shared folder and hands the next
one what it reads back. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, extendible, langid, ngram_join, pfair
from tidemark.llm.common import stored, table, with_file_order

SHARD_BYTES = 32 << 20


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language known from the labelled ones."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the least id."""
    return ngram_join.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order that interleaves sources by target weight."""
    return pfair.mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the shard that each belongs to, and their place in
    the mix (``position``): the order of the files and rows that the stage
    before it wrote. Shards are to be written in that order."""
    return extendible.assign_shards(with_file_order(docs, "position"), SHARD_BYTES)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Rank-order profiles and MinHash signatures have no SQL form; the rows are
#: tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
