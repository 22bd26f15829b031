"""Helpers shared by the training-data operators: the shared folder, written tables and word patterns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands between words: ASCII white space.
GAP = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where neither the setting nor the context names one (tests, one machine) is a local folder made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veilspan-"))
    return jsc.getCheckpointDir().get()


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, and lost executors don't matter.

    The table is dropped when the session's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bounded_batches(spark: SparkSession) -> None:
    """From now on a batch that goes to Python has 4 MB of columns (or one row), whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def text_of(df: DataFrame) -> Column:
    """The text column; null counts as the empty text."""
    return F.coalesce(df["text"], F.lit(""))


def split_words(text: Column, gap: str = GAP) -> Column:
    """The words between gaps. (Spark's regexp_extract_all copies the text at each match, split doesn't.)"""
    return F.array_remove(F.split(text, gap), "")


def ascii_lower(text: Column) -> Column:
    """A-Z only, so that the lengths of all other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def digits_of(row_id: Column) -> Column:
    """A uniform, reproducible order of rows: 32 hex digits made from the id."""
    return F.md5(F.coalesce(row_id.cast("string"), F.lit("")))
