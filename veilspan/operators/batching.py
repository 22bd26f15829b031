"""Grouping and batching of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import content_hash, prefix_key, size_bucket


def similar_groups(blocks: DataFrame) -> DataFrame:
    """bucket, hash, n of blocks with text: equal texts of a size are a group."""
    rows = blocks.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return rows.groupBy(size_bucket(F.col("text")).alias("bucket"), content_hash(F.col("text")).alias("hash")).agg(F.count(F.lit(1)).alias("n"))


def prefix_groups(blocks: DataFrame) -> DataFrame:
    """prefix, n: blocks that begin alike."""
    return blocks.groupBy(prefix_key(F.col("text")).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def batches(blocks: DataFrame, size: int) -> DataFrame:
    """blocks with `batch`: slices of `size` blocks within each document, by block_seq."""
    line = Window.partitionBy("doc_id").orderBy("block_seq")
    return blocks.withColumn("batch", F.floor((F.row_number().over(line) - 1) / size).cast("int"))


#: The least blocks of a document for each batch size; lengths beyond which it is halved, and under which it grows by a fifth.
BATCH_SIZES = ((1000, 200), (600, 175), (300, 100), (100, 75), (0, 50))
LONG_TEXT, SHORT_TEXT, LEAST_BATCH, MOST_BATCH = 500, 50, 50, 200
#: Fixed value: unique blocks from which work in parallel pays off.
PARALLEL_FROM = 200


def batch_sizes(blocks: DataFrame) -> DataFrame:
    """doc_id, blocks, mean_length, batch_size, parallel: the size of batches for each document, and whether it has blocks enough to go parallel.

    Spark sizes its own tasks; these are for a model server behind hooks.model_detections(). A null text has length 0.
    """
    rows = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.avg(F.coalesce(F.length("text"), F.lit(0))).alias("mean_length"), F.count_distinct(content_hash(F.col("text"))).alias("unique"))
    size = F.lit(BATCH_SIZES[-1][1])
    for least, n in reversed(BATCH_SIZES):
        size = F.when(F.col("blocks") >= least, F.lit(n)).otherwise(size)
    halved, raised = F.greatest(F.lit(LEAST_BATCH), F.floor(size / 2).cast("int")), F.least(F.lit(MOST_BATCH), F.floor(size * 1.2).cast("int"))
    size = F.when(F.col("mean_length") > LONG_TEXT, halved).when(F.col("mean_length") < SHORT_TEXT, raised).otherwise(size)
    return rows.select("doc_id", "blocks", F.round("mean_length", 4).alias("mean_length"), size.cast("int").alias("batch_size"), (F.col("unique") >= PARALLEL_FROM).alias("parallel"))


def batches_by_length(blocks: DataFrame, most: int = 50_000) -> DataFrame:
    """doc_id, batch, first_seq, last_seq, chars: runs of a document's blocks, each with at most `most` characters or a single block.

    A run ends where the next block would exceed the limit; a fold over one document's block lengths.
    """
    rows = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_seq", F.length("text").alias("n")))).alias("b"))
    run = "array<struct<first:int,last:int,chars:int>>"
    start = F.array().cast(run)

    def step(a, x):
        last = F.element_at(a, -1)
        new = F.struct(x["block_seq"].alias("first"), x["block_seq"].alias("last"), x["n"].alias("chars"))
        more = F.struct(last["first"].alias("first"), x["block_seq"].alias("last"), (last["chars"] + x["n"]).alias("chars"))
        fits = last["chars"] + x["n"] <= most
        return F.when((F.size(a) > 0) & F.coalesce(fits, F.lit(False)), F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(more))).otherwise(F.concat(a, F.array(new)))

    done = F.aggregate("b", start, lambda a, x: F.when(F.size(a) == 0, F.array(F.struct(x["block_seq"].alias("first"), x["block_seq"].alias("last"), x["n"].alias("chars")))).otherwise(step(a, x)))
    return rows.select("doc_id", F.posexplode(done).alias("batch", "r")).select("doc_id", "batch", F.col("r.first").alias("first_seq"), F.col("r.last").alias("last_seq"), F.col("r.chars").alias("chars"))
