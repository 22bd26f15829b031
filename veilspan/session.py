"""Session helpers shared by tests, bench and the driver entry."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "veilspan") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("VEILSPAN_SHUFFLE_PARTITIONS", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("VEILSPAN_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; the path goes to Spark's reader only, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a table with fewer splits than cores (one small file, say) is dealt out, any larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def dealt(df: DataFrame) -> DataFrame:
    """df over all cores, whatever its splits: for narrow rows that each cost much work, whose bytes don't show it."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def bounded_batches(spark: SparkSession) -> None:
    """From now on a batch that goes to Python has 4 MB of columns (or one row), whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or the context's; a local session without either gets one."""
    named, jsc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="veilspan-"))
    return named or jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and checkpointed in the shared folder, so that it survives lost executors."""
    shared(df.sparkSession)
    return df.checkpoint()
