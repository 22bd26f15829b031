"""Queries that go through the shared folder: streams, whose rows are written there and read back, and a store of detections between runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import caching, extract
from ..session import shared
from ..sources.rules import ASCII_RULES
from ..streaming import ingest
from .catalog import QUERIES as FIRST, _docs

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def _files(d: str, name: str) -> str:
    """A table's path as a pattern, which a stream reads whether it is one file or a folder."""
    return f"{d}/{name}.parque[t]"


def _streamed(found: DataFrame) -> DataFrame:
    folder = f"{shared(found.sparkSession).rstrip('/')}/stream-{uuid.uuid4().hex}"
    ingest.to_files(found, f"{folder}/rows", f"{folder}/state").awaitTermination()
    return found.sparkSession.read.schema(found.schema).parquet(f"{folder}/rows")


def q100(spark, d):
    """q01 over a stream of the documents' files."""
    found = ingest.detections(ingest.documents(spark, _files(d, "documents")), ASCII_RULES)
    return _streamed(found).select("doc_id", "category", "original_value", "start", "end", "confidence", "method")


def q101(spark, d):
    """Events by type and hour, for hours that ended ten minutes or more before the last event."""
    events = ingest.documents(spark, _files(d, "events"), EVENTS).select("ts", F.col("event_type").alias("category"))
    return _streamed(ingest.counts(events, "ts", "1 hour", "10 minutes").select(F.col("window.start").alias("hour"), "category", "n"))


def q102(spark, d):
    """q01 through a store: one run over every second document, an eviction, and one over all."""
    path = f"{shared(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    docs = _docs(spark, d)
    detect = lambda b: extract.scan(b, ASCII_RULES)
    caching.with_store(docs.where("doc_id % 2 = 0"), detect, path, 100, 1000.0)
    caching.evicted(spark, path, 100, now=1020.0)
    found = caching.with_store(docs, detect, path, 100, 1050.0)
    return found.select("doc_id", "category", "original_value", "start", "end", "confidence", "method")


QUERIES = {
    "q102_store_of_detections": (q102, FIRST["q01_span_scan"][1]),
    "q100_stream_scan": (q100, FIRST["q01_span_scan"][1]),
    "q101_stream_windows": (q101, "WITH e AS (SELECT date_trunc('hour', ts) AS hour, event_type AS category, max(ts) OVER () AS last FROM events) SELECT hour, category, count(*) AS n FROM e WHERE hour + INTERVAL 1 HOUR <= last - INTERVAL 10 MINUTE GROUP BY hour, category"),
}
