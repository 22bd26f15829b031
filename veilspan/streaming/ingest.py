"""Streams of documents: the same scan over files as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import extract
from ..sources.blocks import whole_blocks
from ..sources.rules import Rule

DOCUMENTS = "doc_id long, text string"


def documents(spark: SparkSession, path: str, schema: str = DOCUMENTS, files: int = 100) -> DataFrame:
    """Parquet files below a path, at most `files` of them in one batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def detections(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """extract.scan() of a stream; it keeps no state."""
    return extract.scan(whole_blocks(docs), rules)


def once_each(docs: DataFrame, time_column: str, delay: str) -> DataFrame:
    """A stream without texts that were seen within the delay; the state is bounded by the watermark."""
    return docs.withColumn("_key", F.md5("text")).withWatermark(time_column, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def counts(found: DataFrame, time_column: str, window: str, delay: str) -> DataFrame:
    """Detections by category in windows of time, each given out once its end is `delay` past."""
    return found.withWatermark(time_column, delay).groupBy(F.window(time_column, window), "category").agg(F.count(F.lit(1)).alias("n"))


def to_files(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what there is now and stops; run again it goes on where it stopped."""
    return found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
