"""Importance resampling towards a target distribution, over hashed runs of words, with partition-local word tries.

Features are all runs of one and two words, hashed by CRC-32 into BUCKETS. A bucket's gain is the log ratio of its smoothed shares in the
target and in the corpus; a document's weight is the mean gain of its features, and the documents with the highest sums of weight and Gumbel
noise are drawn, which is a draw without replacement in proportion to exp(weight / 1000).

A task keeps the words of its texts in a trie: a node for each word, with a child for each word that followed it. A node holds the count of
its feature and the CRC state of the path to it, from which a child's is carried on, so a feature is hashed once in a trie and not once in a
text. Nodes lie in numpy arrays, and texts grow and walk the trie a piece at a time. To count, tasks send the totals of buckets, BUCKETS rows at
most, and these are added up. To score, tries are grown again with gains in the nodes, and each text walks through its paths. A trie that reaches
NODES is emptied, after its counts went to the totals: it only saves work.

Ranks need no global sort: scores are whole numbers within a few ten thousand of 0, so the number of documents at each score says where the draw
ends and at which rank each score begins; only documents at the same score are ordered together.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, written

BUCKETS = 10_000
#: Words that a document must have to be drawn; percent of these documents that are drawn.
MIN_WORDS, PERCENT = 20, 25
SEED = 7
#: Nodes that a task's trie holds at most, but for what one piece of PIECE bytes of texts, or one longer text, adds.
NODES, PIECE = 1_000_000, 1 << 20
#: Words are runs of digits, letters and anything beyond ASCII: other bytes end them, and A-Z are lower-cased.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_START = np.uint32(0xFFFFFFFF)
#: The register after a byte, from zlib's own CRC of that byte.
_CRC = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
_CRC = (_CRC ^ _START)[np.arange(256) ^ 255] ^ np.uint32(0x00FFFFFF)


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text."""
    return text.translate(_TABLE).split()


def _carried(state: np.ndarray, word: np.ndarray, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 registers, carried on through the bytes text[begin:end] of each one's word, all of them a byte at a time."""
    state, todo, at = state.copy(), np.arange(len(state)), begin[word]
    stop = end[word]
    while True:
        more = at < stop
        if not more.all():
            todo, at, stop = todo[more], at[more], stop[more]
        if not len(todo):
            return state
        old = state[todo]
        state[todo] = _CRC[(old ^ text[at]) & 255] ^ (old >> np.uint32(8))
        at = at + 1


class Trie:
    """Runs of one and two words; nodes lie in arrays: those of first words in the order met, those of second words by (first, second).

    A node has the count of its feature and the CRC register after its path, from which its children's are carried on.
    """

    def __init__(self, gains: np.ndarray | None = None):
        self.words: dict[bytes, int] = {}
        self.state, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.pair, self.pair_state, self.pair_count = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.gains = gains

    def __len__(self) -> int:
        return len(self.words) + len(self.pair)

    def grow(self, rows: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Adds and counts the paths of all rows: their nodes of first words, of second words (row by row), and where the latter's rows begin and end."""
        ids, known = self.words, len(self.words)
        met = np.array([ids.setdefault(w, len(ids)) for row in rows for w in row], np.int64)
        new = list(islice(ids, known, None))
        text = np.frombuffer(b"".join(new), np.uint8).astype(np.uint32)
        end = np.cumsum([len(w) for w in new], dtype=np.int64)
        begin = end - np.array([len(w) for w in new], np.int64)
        self.state = np.concatenate([self.state, _carried(np.full(len(new), _START, np.uint32), np.arange(len(new)), text, begin, end)])
        self.count = np.concatenate([self.count, np.zeros(len(new), np.int64)]) + np.bincount(met, minlength=len(ids))
        ends = np.cumsum([len(row) for row in rows], dtype=np.int64)
        last = np.zeros(len(met), bool)
        last[ends[np.diff(ends, prepend=0) > 0] - 1] = True
        inner = np.flatnonzero(~last)
        paths, path, times = np.unique(met[inner] << 32 | met[inner + 1], return_inverse=True, return_counts=True)
        at = np.searchsorted(self.pair, paths)
        fresh = np.ones(len(paths), bool)
        inside = at < len(self.pair)
        fresh[inside] = self.pair[at[inside]] != paths[inside]
        added = paths[fresh]
        second, words = np.unique(added & 0xFFFFFFFF, return_inverse=True)
        names = list(ids)
        spelt = [b" " + names[w] for w in second.tolist()]
        text = np.frombuffer(b"".join(spelt), np.uint8).astype(np.uint32)
        end = np.cumsum([len(w) for w in spelt], dtype=np.int64)
        begin = end - np.array([len(w) for w in spelt], np.int64)
        states = _carried(self.state[added >> 32], words, text, begin, end)
        self.pair, self.pair_state, self.pair_count = (np.insert(old, at[fresh], more) for old, more in ((self.pair, added), (self.pair_state, states), (self.pair_count, np.zeros(len(added), np.int64))))
        nodes = np.searchsorted(self.pair, paths)
        self.pair_count[nodes] += times
        steps = np.concatenate([[0], np.cumsum(~last)])
        return met, nodes[path], ends, steps

    def walk(self, rows: list[list[bytes]]) -> list[int]:
        """Each row's sum of the gains of its features."""
        first, second, ends, steps = self.grow(rows)
        of_first, of_second = (np.concatenate([[0], np.cumsum(self.gains[bucket_of(state)[node]])]) for state, node in ((self.state, first), (self.pair_state, second)))
        begins = np.concatenate([[0], ends])[:-1]
        return (of_first[ends] - of_first[begins] + of_second[steps[ends]] - of_second[steps[begins]]).tolist()

    def totals(self) -> np.ndarray:
        """The counts of all nodes by bucket."""
        out = np.zeros(BUCKETS, np.int64)
        np.add.at(out, bucket_of(self.state), self.count)
        np.add.at(out, bucket_of(self.pair_state), self.pair_count)
        return out


def bucket_of(state: np.ndarray) -> np.ndarray:
    return (state ^ _START) % np.uint32(BUCKETS)


def _texts(batch: pa.RecordBatch) -> Iterator[list[list[bytes]]]:
    """The words of the texts, in pieces of PIECE bytes or one longer text; together they are the batch's, in order."""
    rows, held = [], 0
    for text in batch.column("text"):
        rows.append(words_of(text.as_buffer().to_pybytes()))
        held += len(text.as_buffer())
        if held >= PIECE:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals, trie = np.zeros(BUCKETS, np.int64), Trie()
    for batch in batches:
        for rows in _texts(batch):
            trie.grow(rows)
            if len(trie) >= NODES:
                totals += trie.totals()
                trie = Trie()
    totals += trie.totals()
    at = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(totals[at])], ["bucket", "n"])


def _binary(table: DataFrame):
    return F.coalesce(table["text"], F.lit("")).cast("binary").alias("text")


def bucket_totals(table: DataFrame) -> list[int]:
    """How many features of table (text) each bucket has; the driver gets BUCKETS rows at most."""
    got = table.select(_binary(table)).mapInArrow(_counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = [0] * BUCKETS
    for r in got:
        out[r.bucket] = r.n
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Each bucket's log ratio of smoothed shares, in thousandths, rounded down."""
    s, t = float(sum(corpus) + BUCKETS), float(sum(target) + BUCKETS)
    return [math.floor(1000 * math.log((float(b + 1) * s) / (float(a + 1) * t))) for a, b in zip(corpus, target, strict=True)]


def weigh(docs: DataFrame, gain: list[int], keep: list[str]) -> DataFrame:
    """row (a struct of the columns in keep), n_words, n_features and weight of each row of docs (text)."""
    table = docs.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(table.value)
        for batch in batches:
            n, sums = [], []
            for texts in _texts(batch):
                n += map(len, texts)
                sums += trie.walk(texts)
                if len(trie) >= NODES:
                    trie = Trie(table.value)
            n, sums = np.array(n, np.int64), np.array(sums, np.int64)
            features = np.maximum(2 * n - 1, 0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n), pa.array(features), pa.array(sums // np.maximum(features, 1))], ["row", "n_words", "n_features", "weight"])

    row = F.struct(*(docs[c] for c in keep))
    source = docs.select(row.alias("row"), _binary(docs))
    return source.mapInArrow(rows, f"row {source.schema['row'].dataType.simpleString()}, n_words long, n_features long, weight long")


def scored(docs: DataFrame, target: DataFrame, keep: list[str], seed: int = SEED) -> DataFrame:
    """Each row of docs (doc_id, text) with n_words, n_features, weight and score; row is a struct of the columns in keep and the last, the id."""
    bounded_batches(docs.sparkSession)
    rows = weigh(docs, gains(bucket_totals(docs), bucket_totals(target)), [*keep, "doc_id"])
    last = F.col("row")["doc_id"].cast("string")
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(last, F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    return rows.withColumn("score", (F.col("weight") + gumbel).cast("long"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Each row of docs (doc_id, text) with what the draw towards target (text) makes of it.

    Returns doc_id, n_features, weight, score and rank, which is null for documents that aren't drawn. Of the rows with at least min_words words,
    floor(percent * n / 100) with the highest scores are drawn; equal scores go by the smaller doc_id, null last. Null and empty texts
    have no features and weight 0; a null doc_id counts as the empty text in the noise. Repeated rows have equal scores and take ranks of their own, in any order.
    A very long text is walked whole. Where docs or target is empty the gains follow from the other alone. Other columns, whatever their names, are
    not read. An empty table gives no rows.
    """
    rows = scored(docs.select("doc_id", "text"), target, [], seed).select("row.doc_id", "n_features", "weight", "score", (F.col("n_words") >= min_words).alias("able"))
    rows = written(rows, "resampling-scores")
    counts = rows.where("able").groupBy("score").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("score").desc()).collect()  # scores lie within some ten thousand of 0
    left = percent * sum(r.n for r in counts) // 100
    begins, at, cut = [], 0, None
    for r in counts:
        if at < left:
            begins.append((r.score, at))
            cut = r.score
        at += r.n
    spark = docs.sparkSession
    starts = F.broadcast(spark.createDataFrame(begins, "score long, before long"))
    near = F.col("able") & (F.col("score") >= cut) if cut is not None else F.lit(False)
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    drawn = rows.where(near).join(starts, "score").withColumn("rank", F.col("before") + place)
    rank = F.when(F.col("rank") <= left, F.col("rank")).cast("long")
    columns = ["doc_id", "n_features", "weight", "score"]
    return drawn.select(*columns, rank.alias("rank")).unionByName(rows.where(~near).select(*columns, F.lit(None).cast("long").alias("rank")))


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """resample() of all documents towards the benchmark."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target)


#: The same; CRC-32 goes through the bytes of each distinct feature, one byte a step for all features.
OP12_SQL = rf"""
WITH RECURSIVE low AS (
  SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS i, text FROM documents UNION ALL SELECT 't', NULL, -row_number() OVER (), text FROM benchmark
), w AS (
  SELECT side, id, i, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low
), f AS (
  SELECT side, i, unnest(w) AS f FROM w
  UNION ALL SELECT side, i, unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) FROM w WHERE len(w) > 1
), distinct_f AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)
), steps AS (
  SELECT n AS b, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM (SELECT unnest(range(256)) AS n)
), crc(f, h, k, r) AS (
  SELECT f, h, 0, CAST(4294967295 AS BIGINT) FROM distinct_f
  UNION ALL
  SELECT f, h, k + 1, xor(r >> 8, c) FROM crc JOIN steps ON b = xor(r & 255, CAST('0x' || h[2 * k + 1:2 * k + 2] AS BIGINT)) WHERE 2 * k < length(h)
), buckets AS (
  SELECT f, xor(r, 4294967295) % {BUCKETS} AS bucket FROM crc WHERE 2 * k = length(h)
), n AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM f JOIN buckets USING (f) GROUP BY bucket
), sums AS (
  SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM n
), gain AS (
  SELECT bucket, floor(1000 * ln((CAST(n.t + 1 AS DOUBLE) * CAST(sums.s + {BUCKETS} AS DOUBLE)) / (CAST(n.s + 1 AS DOUBLE) * CAST(sums.t + {BUCKETS} AS DOUBLE))))::BIGINT AS g FROM n, sums
), weights AS (
  SELECT i, count(*) AS n, CAST(floor(CAST(sum(g) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM f JOIN buckets USING (f) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY i
), scores AS (
  SELECT w.i, w.id AS doc_id, len(w.w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('{SEED}:' || coalesce(CAST(w.id AS VARCHAR), '')), 1, 8)) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM w LEFT JOIN weights ON weights.i = w.i WHERE side = 'd'
), drawn AS (
  SELECT i, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank, {PERCENT} * count(*) OVER () // 100 AS most FROM scores WHERE n_words >= {MIN_WORDS}
)
SELECT doc_id, n_features, weight, CAST(score AS BIGINT) AS score, CAST(CASE WHEN rank <= most THEN rank END AS BIGINT) AS rank FROM scores LEFT JOIN drawn ON drawn.i = scores.i
"""
