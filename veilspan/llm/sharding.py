"""Sharding by minimax contiguous partition of atomic groups (DataFrame operations only).

All rows of one text are one atomic group; groups are ordered by the MD5 of the text, and shards are contiguous
in that order. The capacity is the smallest for which a greedy walk needs no more shards than asked for; it is found by
binary search, and the cuts lie where that walk ends its shards.

No list of groups reaches the driver. It holds sums by key prefix (4,096 at first) and asks again, with two more hex
digits, only for prefixes in which a cut may lie; a walk that treats prefixes as atoms and one that may cut them anywhere
bound the capacity from both sides, and the search ends when all prefixes between them hold one group each.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_of, written

#: Hex digits of the first summing, of each later one, and of a whole key.
FIRST, STEP, WHOLE = 3, 2, 32


class _Line:
    """Prefixes in order with their sums; what lies in one that isn't atomic may be cut if `free`."""

    def __init__(self, nodes: dict[str, tuple[int, bool]]):
        self.keys = sorted(nodes)
        self.atomic = [nodes[k][1] for k in self.keys]
        self.ends, total = [], 0
        for k in self.keys:
            total += nodes[k][0]
            self.ends.append(total)
        self.total = total

    def reach(self, start: int, capacity: int, free: bool) -> int:
        """How far a shard of this capacity comes from start, as a sum of sizes."""
        most = min(start + capacity, self.total)
        i = bisect_right(self.ends, most)
        if free and i < len(self.keys) and not self.atomic[i]:
            return most
        return max(start, self.ends[i - 1] if i else 0)

    def walk(self, capacity: int, shards: int, free: bool) -> list[int]:
        at, out = 0, []
        for _ in range(shards):
            at = self.reach(at, capacity, free)
            out.append(at)
        return out

    def least(self, shards: int, free: bool) -> int:
        """The smallest capacity with which the walk reaches the end."""
        low, high = -(-self.total // shards), self.total
        while low < high:
            mid = (low + high) // 2
            if self.walk(mid, shards, free)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low


def _sums(rows: DataFrame, digits: int) -> dict[str, tuple[int, bool]]:
    """Sums by prefix; at most 16**digits rows, or as many as the filter of the caller leaves."""
    got = (
        rows.groupBy(F.substring("group_key", 1, digits).alias("prefix"))
        .agg(F.sum("size").alias("size"), F.min("group_key").alias("a"), F.max("group_key").alias("b"))
        .collect()
    )
    return {(r.a if r.a == r.b else r.prefix): (int(r["size"]), r.a == r.b) for r in got}


def cuts(rows: DataFrame, shards: int) -> tuple[list[str], int]:
    """Keys at which shards end (the last key of each shard but the last), and the capacity.

    rows: group_key (hex digits), size. Each round collects sums of at most a few hundred prefixes.
    """
    nodes, digits = _sums(rows, FIRST), FIRST
    while True:
        line = _Line(nodes)
        if not line.total:
            return [], 0
        low, high = line.least(shards, True), line.least(shards, False)
        first, last = line.walk(low, shards, False), line.walk(high, shards, True)
        open_ = {
            line.keys[i]
            for a, b in zip(first, last, strict=True)
            for i in range(bisect_right(line.ends, a), min(len(line.keys), bisect_right(line.ends, b) + 1))
            if not line.atomic[i]
        }
        if not open_ or digits >= WHOLE:
            ends = line.walk(high, shards, False)
            return [line.keys[bisect_right(line.ends, e) - 1] for e in ends[:-1] if 0 < e < line.total], high
        near = F.lit(False)
        for k in sorted(open_):
            near |= F.col("group_key").startswith(k)
        digits += STEP
        nodes = {k: v for k, v in nodes.items() if k not in open_} | _sums(rows.where(near), digits)


def ranked(df: DataFrame, within: list[str], ties: list[str], order: str, name: str) -> DataFrame:
    """A gapless rank from 0 within each value of `within`, by hex digits in `order` and then `ties`.

    A value may hold any share of the rows: ranks are taken within 4,096 ranges of the order, to which the counts of the
    ranges before are added, so no task sorts a whole value.
    """
    df = df.withColumn("_range", F.substring(order, 1, FIRST))
    counts = df.groupBy(*within, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*within, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*within, "_range").orderBy(order, *ties)
    df = df.withColumn("_rank", F.row_number().over(inside) - 1)
    return df.join(counts, [*within, "_range"]).withColumn(name, F.col("_rank") + F.col("_before")).drop("_range", "_rank", "_before")


def shard_of(key: Column, ends: list[str]) -> Column:
    """The number of shards that end before the key."""
    return sum(((key > F.lit(e)).cast("int") for e in ends), F.lit(0))


def _order(docs: DataFrame) -> Column:
    """A uniform, reproducible order of rows, by id and text, so that rows without ids are dealt out too."""
    return F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(":"), F.md5(text_of(docs))))


def assign_shards(docs: DataFrame, shards: int = 8, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row of docs (doc_id, text) with its shard and slot.

    Returns row (a struct of the columns in keep), size (UTF-8 bytes plus 1), text_crc32, shard, slot, capacity. A null text counts as the
    empty one; a null doc_id is ordered as the empty text. Repeated rows are told apart by nothing, so they take neighbouring slots in
    any order. An empty table gives no rows. Fewer groups than shards leave shards empty. Columns may have any names.
    """
    text = text_of(docs)
    size, crc = (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    groups = written(docs.select(F.md5(text).alias("group_key"), size), "shard-groups")
    ends, capacity = cuts(groups, shards)
    row = F.struct(*(docs[c] for c in keep)).alias("row")
    rows = docs.select(row, size, crc, shard_of(F.md5(text), ends).cast("int").alias("shard"), _order(docs).alias("order"))
    rows = ranked(rows, ["shard"], ["text_crc32", "size"], "order", "slot")
    return rows.select("row", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"), F.lit(capacity).cast("long").alias("capacity"))


def dealt(docs: DataFrame, shards: int = 8) -> DataFrame:
    """docs with size, text_crc32, shard and slot of assign_shards(); columns of docs that have these names are replaced.

    Rows lie by shard and slot where the ranking left them, in ranges of their order; nothing else is shuffled.
    """
    made = ("size", "text_crc32", "shard", "slot")
    keep = tuple(c for c in docs.columns if c.lower() not in made)
    return assign_shards(docs, shards, keep).select("row.*", *made)


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    """The digest of assign_shards() over all documents, under the law `bytes`."""
    out = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: For every capacity from the mean to the mean and the largest group, eight greedy steps; the smallest that ends is taken.
#: DuckDB has no CRC-32, so its reflected polynomial 0xEDB88320 is folded over the bytes, eight shifts each.
OP4_SQL = """
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, md5(coalesce(text, '')) AS k FROM documents
), groups AS (
  SELECT k, sum(size)::BIGINT AS size FROM docs GROUP BY k
), line AS (
  SELECT k, CAST(sum(size) OVER (ORDER BY k) AS BIGINT) AS done FROM groups
  UNION ALL SELECT '', 0
), law AS (
  SELECT CAST(ceil(sum(size) / 8.0) AS BIGINT) AS low, max(size) AS wide, sum(size)::BIGINT AS total FROM groups
), s0 AS (SELECT unnest(range(low, low + wide + 1)) AS c, CAST(0 AS BIGINT) AS p0 FROM law
), s1 AS (SELECT c, line.done AS p1 FROM s0 ASOF JOIN line ON p0 + c >= line.done
), s2 AS (SELECT s1.*, line.done AS p2 FROM s1 ASOF JOIN line ON p1 + c >= line.done
), s3 AS (SELECT s2.*, line.done AS p3 FROM s2 ASOF JOIN line ON p2 + c >= line.done
), s4 AS (SELECT s3.*, line.done AS p4 FROM s3 ASOF JOIN line ON p3 + c >= line.done
), s5 AS (SELECT s4.*, line.done AS p5 FROM s4 ASOF JOIN line ON p4 + c >= line.done
), s6 AS (SELECT s5.*, line.done AS p6 FROM s5 ASOF JOIN line ON p5 + c >= line.done
), s7 AS (SELECT s6.*, line.done AS p7 FROM s6 ASOF JOIN line ON p6 + c >= line.done
), s8 AS (SELECT s7.*, line.done AS p8 FROM s7 ASOF JOIN line ON p7 + c >= line.done
), best AS (
  SELECT s8.* FROM s8, law WHERE p8 = total ORDER BY c LIMIT 1
), put AS (
  SELECT docs.*, CAST((done > p1)::INT + (done > p2)::INT + (done > p3)::INT + (done > p4)::INT + (done > p5)::INT + (done > p6)::INT + (done > p7)::INT AS INTEGER) AS shard
  FROM docs JOIN line USING (k), best
), bytes AS (
  SELECT DISTINCT t, list_transform(range(0, CAST(strlen(t) AS BIGINT)), lambda i: CAST(('0x' || substr(hex(encode(t)), CAST(2 * i + 1 AS INTEGER), 2)) AS BIGINT)) AS b FROM docs
), crcs AS (
  SELECT t, xor(list_reduce(b, lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS crc FROM bytes
)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || k), crc, size) - 1 AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM put JOIN crcs USING (t)
"""
