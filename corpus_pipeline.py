"""A training corpus from documents, in five stages, each written as Parquet and read again as the next one's input.

The quality classifier drops what it rejects, near copies are reduced to one of each group, contaminated documents
are dropped, the sources are mixed to their targets, and the mix is dealt into shards.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from veilspan.llm import decontam, mixing, rulefit, sharding, simhash_wide
from veilspan.llm.common import shared_dir

SHARDS = 8


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts; it learns from labels of the documents at hand.

    Null, empty and very long texts are scored like any other, whole, and dropped where the score that follows from their statistics is too low. Repeated rows
    and ties of the score stay or go together. Columns may have any names. An empty table gives no rows.
    """
    model = rulefit.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rulefit.accepted(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (simhash_wide.one_of_each): what meets in the SimHash index of bytes, verified by exact similarity.

    Very long texts are compared whole. Texts without words (null too) are copies of each other, and so are repeated rows; the smallest id stays, ids that are null come last.
    Columns may have any names. An empty table gives no rows.
    """
    return simhash_wide.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of a benchmark item occurs.

    Null and empty texts hold none and stay; very long ones are searched whole; repeated rows stay or go together. Columns may have any names. Without documents there are no rows,
    and without items all stay.
    """
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), docs.columns)
    return found.where("n_hit = 0").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole number (not at all, or up to three times), in the schedule's order.

    Texts without words (null too) aren't in the mix; very long ones are taken like any other, by their words; a null source is a source; repeated rows are documents of their own. Columns may
    have any names. An empty table gives no rows.
    """
    return mixing.in_order(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row of the mix with its shard and its slot in it, written by shard.

    The columns of docs but those named like the results, and size, text_crc32, shard, slot. Null texts count as empty, very long ones are one row of their size; copies of a text share a
    shard, in neighbouring slots if their ids are equal. An empty table gives no rows.
    """
    return sharding.dealt(docs, SHARDS)


STAGES = [
    ("quality_classifier", classify_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: The classifier's training and hashes can't be written in SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, through Parquet tables in the shared folder."""
    folder = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
