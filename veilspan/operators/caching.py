"""Detections kept between runs, by the exact hash of the text: a store with expiry, and eviction of what was used longest ago."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import prefix_key


#: Buckets of keys; seconds until an entry expires; entries kept by evicted(), the last used ones.
BUCKETS, EXPIRY, MOST = 64, 3600, 1_000_000
_ENTRIES, _USES, _STAGED = "entries", "uses", "staged"


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _committed(rows: DataFrame, path: str, kind: str) -> None:
    """Adds rows to a part of the store: written aside, and moved in by one rename, so that nobody reads half of them."""
    name = uuid.uuid4().hex
    staged = f"{path}/{_STAGED}/{name}"
    rows.write.partitionBy("bucket").parquet(staged)
    fs, source = _fs(rows.sparkSession, staged)
    jvm = rows.sparkSession.sparkContext._jvm
    if not any(s.isDirectory() for s in fs.listStatus(source)):  # no rows
        fs.delete(source, True)
        return
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}"))
    if not fs.rename(source, jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}/run={name}")):
        raise OSError(f"can't commit {staged}")


def _read(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """All committed rows of a part of the store; none where it isn't there."""
    fs, target = _fs(spark, f"{path}/{kind}")
    if not fs.exists(target) or not fs.listStatus(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, run string").parquet(f"{path}/{kind}").drop("run")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("_key"), F.lit(BUCKETS)).cast("int").alias("bucket")


def with_store(blocks: DataFrame, detect: Callable[[DataFrame], DataFrame], path: str, expiry: float = EXPIRY, now: float | None = None) -> DataFrame:
    """detect() over the blocks, through a store of Parquet files: only texts that it has no entry of, younger than `expiry` seconds, are searched, and then added.

    The store holds a row for each text, with its detections as an array, in buckets by the key's hash, and when it was written; and when each run used which texts.
    Rows are committed by one rename, so runs at the same time and lost ones do no harm; a text that it holds twice is read once, from the newest
    entry. Texts that merely begin alike or differ in case are different. `now` is in seconds, the clock's if it isn't given. Blocks without
    text have no detections. evicted() keeps the store in bounds.
    """
    spark = blocks.sparkSession
    now = time.time() if now is None else now
    keyed = blocks.withColumn("_key", F.sha2("text", 256)).where(F.trim("text") != "").withColumn("bucket", _bucket())
    known = _read(spark, path, _ENTRIES, "_key string, written double, bucket int").where(F.col("written") > now - expiry)
    new = keyed.join(known.select("bucket", "_key").distinct(), ["bucket", "_key"], "left_anti")
    one = new.groupBy("_key").agg(F.first("text").alias("text")).select(F.lit(0).alias("doc_id"), F.col("_key").alias("block_id"), "text")
    found = detect(one)
    rest = [f for f in found.schema if f.name not in ("doc_id", "block_id")]
    schema = f"_key string, found array<struct<{','.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in rest)}>>, written double, bucket int"
    arrays = found.groupBy(F.col("block_id").alias("_key")).agg(F.collect_list(F.struct(*(f.name for f in rest))).alias("found"))
    _committed(one.select(F.col("block_id").alias("_key")).join(arrays, "_key", "left").select("_key", "found", F.lit(float(now)).alias("written"), _bucket()), path, _ENTRIES)
    _committed(keyed.select("_key", "bucket").distinct().withColumn("used", F.lit(float(now))), path, _USES)
    every = _newest(_read(spark, path, _ENTRIES, schema).where(F.col("written") > now - expiry))
    out = keyed.select("doc_id", "block_id", "bucket", "_key").join(every, ["bucket", "_key"])
    return out.select("doc_id", "block_id", F.explode("found").alias("_f")).select("doc_id", "block_id", "_f.*")


def _newest(entries: DataFrame) -> DataFrame:
    return entries.groupBy("bucket", "_key").agg(F.max_by("found", "written").alias("found"), F.max("written").alias("written"))


def evicted(spark: SparkSession, path: str, expiry: float = EXPIRY, most: int = MOST, now: float | None = None) -> tuple[int, int]:
    """Rewrites the store at path with the newest entry of each text that isn't expired, and of these the `most` used last; kept and dropped entries.

    Texts used at the same time go by key. The new rows are committed before the old runs are deleted, so a run in between reads entries twice, which does no
    harm; a store that isn't there stays so. No other eviction may run at the same time.
    """
    now = time.time() if now is None else now
    fs, target = _fs(spark, f"{path}/{_ENTRIES}")
    if not fs.exists(target) or not fs.listStatus(target):
        return 0, 0
    old = {kind: [s.getPath() for s in fs.listStatus(_fs(spark, f"{path}/{kind}")[1])] for kind in (_ENTRIES, _USES)}
    stored = spark.read.option("basePath", f"{path}/{_ENTRIES}").parquet(f"{path}/{_ENTRIES}").drop("run")
    uses = spark.read.option("basePath", f"{path}/{_USES}").parquet(f"{path}/{_USES}").groupBy("bucket", "_key").agg(F.max("used").alias("used"))
    live = _newest(stored.where(F.col("written") > now - expiry)).join(uses, ["bucket", "_key"], "left").withColumn("used", F.coalesce("used", "written"))
    # runs share one time of use, so there are few of them: counts say at which the bound is reached, and only texts of that time are ordered
    left, cut = most, None
    for r in live.groupBy("used").count().orderBy(F.desc("used")).toLocalIterator():
        if r["count"] > left:
            cut = r.used
            break
        left -= r["count"]
    if cut is not None:
        edge = live.where(F.col("used") == cut).orderBy("_key").limit(left)
        live = live.where(F.col("used") > cut).unionByName(edge)
    before, kept = stored.select("_key").distinct().count(), live.count()
    _committed(live.select("_key", "found", "written", "bucket"), path, _ENTRIES)
    _committed(live.select("_key", "bucket", "used"), path, _USES)
    for paths in old.values():
        for p in paths:
            fs.delete(p, True)
    return kept, before - kept


def once_for_similar(blocks: DataFrame, detect: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """detect() over the first block (by doc_id and block_id) of those that begin alike, its detections copied to all of them.

    `similar_to` is the block that was searched. Offsets and values are that block's, so where texts differ they are a guess, as in any
    cache that goes by the first 50 characters; with_store() and combine.once_for_equal_texts() are exact. Blocks without text have none.
    """
    keyed = blocks.withColumn("_key", F.md5(prefix_key(F.col("text")))).where(F.trim("text") != "")
    place = F.struct("doc_id", "block_id")
    one = keyed.groupBy("_key").agg(F.min_by(F.struct("doc_id", "block_id", "text"), place).alias("b"))
    first = one.select(F.lit(0).alias("doc_id"), F.col("_key").alias("block_id"), F.col("b.text").alias("text"))
    found = detect(first).drop("doc_id").withColumnRenamed("block_id", "_key")
    origin = one.select("_key", F.concat_ws("/", "b.doc_id", "b.block_id").alias("similar_to"))
    return keyed.select("doc_id", "block_id", "_key").join(origin, "_key").join(found, "_key").drop("_key")


def cache_statistics(blocks: DataFrame) -> DataFrame:
    """One row: requests, misses (the first block of each text), hits, hit_rate (percent, 0 without requests), size: of a cache by exact text."""
    rows = blocks.where(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy(F.sha2("text", 256).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    out = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("requests"), F.count(F.lit(1)).alias("misses"))
    hits = F.col("requests") - F.col("misses")
    rate = F.when(F.col("requests") > 0, F.round(hits * 100.0 / F.col("requests"), 2)).otherwise(F.lit(0.0))
    return out.select("requests", "misses", hits.alias("hits"), rate.alias("hit_rate"), F.col("misses").alias("size"))
