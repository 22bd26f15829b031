"""Quality rules: text statistics, and a hashed n-gram log-likelihood ratio of trusted target to raw corpus.

Two multinomials over BUCKETS hashed byte n-grams are counted: one over all documents, one over trusted ones. A
document's score is the mean, over its n-grams, of the log ratio of the two; it is kept if the score reaches a fixed
threshold. Nothing is drawn at random: every document gets its verdict from its own text and the two tables.

Trusted are all documents whose labels all say quality 1. Their ids are broadcast up to BROADCAST_IDS; beyond, the join shuffles. The raw
multinomial counts every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import written

GRAM, BUCKET_BITS = 4, 16
BUCKETS = 1 << BUCKET_BITS
#: Trusted ids are broadcast up to this number (8 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 500_000
#: The least mean log ratio (natural logarithm) of a kept document.
THRESHOLD = -0.3
#: Added to each bucket's count in both tables.
SMOOTHING = 1.0
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def gram_buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte but the last GRAM - 1."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    value = np.zeros(n, np.uint32)
    for i in range(GRAM):
        value |= data[i : i + n].astype(np.uint32) << np.uint32(8 * i)
    return (value * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)


def _inside(offsets: np.ndarray, n: int) -> np.ndarray:
    """Whether the n-gram at each place lies in one row."""
    out = np.ones(n, bool)
    for i in range(1, GRAM):
        at = offsets[1:-1] - i
        out[at[(at >= 0) & (at < n)]] = False
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        trusted = np.asarray(batch.column("trusted").fill_null(False))
        for first, last, data, offsets in tb.chunks(batch.column("text")):
            buckets = gram_buckets(data)
            inside = _inside(offsets, len(buckets))
            counts[0] += np.bincount(buckets[inside], minlength=BUCKETS)
            of = np.repeat(trusted[first:last], np.diff(offsets))[: len(buckets)] & inside
            counts[1] += np.bincount(buckets[of], minlength=BUCKETS)
    at = np.flatnonzero(counts[0])
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0, at]), pa.array(counts[1, at])], ["bucket", "n", "m"])


def trusted_ids(labels: DataFrame) -> DataFrame:
    """id: documents that all their labels call good."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("q")).where("q = 1")
    return good.select("id")


def log_ratios(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """The log ratio of each bucket, from all of docs (doc_id, text) and the ids in trusted.

    Each task sends a row for each bucket that it has seen, and these are added up by bucket; the driver gets their sums, BUCKETS rows
    at most. Without any n-gram in one of the tables all ratios are 0.
    """
    flags = written(trusted.select(F.col("id").alias("_id"), F.lit(True).alias("trusted")), "quality-trusted")
    flags = F.broadcast(flags) if flags.count() <= BROADCAST_IDS else flags
    rows = docs.select("doc_id", "text").join(flags, F.col("doc_id") == F.col("_id"), "left").select("text", "trusted")
    got = rows.mapInArrow(_counted, "bucket int, n long, m long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).toArrow()
    counts = np.zeros((2, BUCKETS))
    for i, c in enumerate(("n", "m")):
        counts[i, got.column("bucket").to_numpy()] = got.column(c).to_numpy()
    if not counts.sum(1).all():
        return np.zeros(BUCKETS)
    shares = (counts + SMOOTHING) / (counts + SMOOTHING).sum(1, keepdims=True)
    return np.log(shares[1] / shares[0])


def mean_ratio(data: np.ndarray, offsets: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """The mean log ratio of each row's n-grams; 0 for a row without."""
    buckets = gram_buckets(data)
    inside = _inside(offsets, len(buckets))
    sums = np.zeros(len(data) + 1)
    np.cumsum(np.where(inside, ratios[buckets], 0.0), out=sums[1 : len(buckets) + 1])
    sums[len(buckets) + 1 :] = sums[len(buckets)]
    n = np.maximum(np.diff(offsets) - GRAM + 1, 0)
    return np.where(n > 0, np.diff(sums[offsets]) / np.maximum(n, 1), 0.0)


def score(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, BASE_COLUMNS and llr of each row of docs (doc_id, text)."""
    table = docs.sparkSession.sparkContext.broadcast(ratios)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: dict[str, list] = {c: [] for c in (*BASE_COLUMNS, "llr")}
            for _, _, data, offsets in tb.chunks(batch.column("text")):
                stats = tb.statistics(data, offsets)
                for c in BASE_COLUMNS:
                    parts[c].append(stats[c])
                parts["llr"].append(mean_ratio(data, offsets, table.value))
            if batch.num_rows:
                arrays = [np.concatenate(v) for v in parts.values()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, arrays)], ["doc_id", *parts])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, {', '.join(f'{c} long' for c in BASE_COLUMNS)}, llr double")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Each row of docs (doc_id, text) with its statistics, its score and whether it is kept.

    Returns doc_id, BASE_COLUMNS, llr, base_failed, kept. A null text counts as the empty one, which fails the base (no
    words) and scores 0; a very long one is counted and scored whole, in memory in proportion to its length. Repeated rows get equal results; a null doc_id is never trusted; without any trusted document all
    scores are 0, and the base alone decides. An empty table gives no rows. Other columns are not read.
    """
    out = score(docs, log_ratios(docs, trusted_ids(labels)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """judge() over all documents, without the score."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(docs.select("doc_id", "text"), labels.select("doc_id", "quality")).drop("llr")


#: The same.
OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, hex(encode(coalesce(text, ''))) AS h FROM documents
), trusted AS (
  SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(coalesce(quality, 0)) = 1
), g AS (
  SELECT doc_id, ((CAST('0x' || x[7:8] || x[5:6] || x[3:4] || x[1:2] AS UBIGINT) * CAST({0x9E3779B1} AS UBIGINT)) % CAST(4294967296 AS UBIGINT)) // CAST({1 << (32 - BUCKET_BITS)} AS UBIGINT) AS k
  FROM (SELECT doc_id, substr(h, CAST(2 * i + 1 AS INTEGER), {2 * GRAM}) AS x FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) // 2 - {GRAM - 1} AS BIGINT))) AS i FROM d))
), c AS (
  SELECT k, count(*) AS n, count(trusted.doc_id) AS m FROM g LEFT JOIN trusted USING (doc_id) GROUP BY k
), r AS (
  SELECT k, ln(((m + {SMOOTHING}) / (sum(m) OVER () + {SMOOTHING * BUCKETS})) / ((n + {SMOOTHING}) / (sum(n) OVER () + {SMOOTHING * BUCKETS}))) AS ratio FROM c
), s AS (
  SELECT doc_id, avg(ratio) AS llr FROM g JOIN r USING (k) GROUP BY doc_id
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(list_slice(w, i, i + 7), ' ')) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)) WHERE n > 1
), inside AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), b AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(inside.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN inside USING (doc_id)
)
SELECT b.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(llr, 0) >= {THRESHOLD} AS kept
FROM b LEFT JOIN s USING (doc_id)
"""
