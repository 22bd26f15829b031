"""Mixing sources to target weights by a low-discrepancy schedule.

The mix has SLOTS slots. Slot n stands at the van der Corput point of n (its bits reversed), and the point's place among the
cumulated targets gives the slot's source; so any stretch of the schedule mixes the sources nearly as the whole does. The
documents of a source, shuffled by a hash, form a line of tokens that is walked again when it ends. The tokens that a
source owes are cut into as many equal blocks as it has slots, and block k goes to its k-th slot. What the mix takes of a document
is the sum of what the blocks of scheduled slots hold of it, and its copies stand in the order of the slots that they begin in.

A source may hold any share of the rows: running sums are taken within 4,096 ranges of the shuffled order, to which the
sums of the ranges before are added, and blocks meet documents by source and number of the block. The schedule has SLOTS rows and
one for each source that is too small for a slot, so it is broadcast behind a check of its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import split_words, text_of, written

BITS = 16
SLOTS = 1 << BITS
WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
RANGE_DIGITS = 3


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """source, source_size -> also weight, target: shares of all sizes by weight, none above `most` times its size.

    Sources in code-point order (null last) take the weights in turn. A target above its limit stops there, and what is left
    is shared by the others' weights: in the order of limit per weight, the first k stop, for the least k for which the next
    doesn't exceed its share. One row per source; its windows span the sources, not the documents.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(turn) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("_limit", F.col("source_size") * most)
    line = Window.orderBy((F.col("_limit") / F.col("weight")), F.col("source").asc_nulls_last())
    before, after = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0))
    rows = rows.withColumns({"_place": F.row_number().over(line), "_left": left, "_weights": F.sum("weight").over(after)})
    stops = F.when(F.col("_limit") * F.col("_weights") >= F.col("_left") * F.col("weight"), F.col("_place"))
    rows = rows.withColumn("_first", F.min(stops).over(everything))
    at_first = F.col("_place") == F.col("_first")
    rows = rows.withColumns({"_l": F.max(F.when(at_first, F.col("_left"))).over(everything), "_w": F.max(F.when(at_first, F.col("_weights"))).over(everything)})
    free = F.when(F.col("_w") > 0, (F.col("weight") * F.col("_l")).cast("double") / F.col("_w")).otherwise(F.lit(0.0))
    target = F.when(F.col("_first").isNull() | (F.col("_place") < F.col("_first")), F.col("_limit").cast("double")).otherwise(free)
    return rows.select("source", "source_size", "weight", target.alias("target"))


def _point(n: Column) -> Column:
    """The bits of n in reverse, as an integer below SLOTS."""
    out = F.lit(0).cast("long")
    for i in range(BITS):
        out = out + F.shiftleft(F.shiftright(n, i).bitwiseAND(F.lit(1)).cast("long"), BITS - 1 - i)
    return out


def schedule(targets: DataFrame) -> DataFrame:
    """slot, source, slot_rank: SLOTS rows, and one more at the end for each source too small for a slot of its own.

    Targets are rounded to whole tokens and cumulated as integers; slot n belongs to the source whose span holds its point.
    """
    spark = targets.sparkSession
    line = Window.orderBy(F.col("source").asc_nulls_last())
    owed = targets.select("source", F.round("target").cast("decimal(38,0)").alias("owed")).where("owed > 0")
    spans = owed.withColumn("end", F.sum("owed").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.withColumns({"begin": F.col("end") - F.col("owed"), "all": F.sum("owed").over(Window.partitionBy())})
    # points of a span: point * all in [begin * SLOTS, end * SLOTS)
    first = F.ceil(F.col("begin") * SLOTS / F.col("all"))
    spans = spans.select("source", first.cast("long").alias("first"), F.ceil(F.col("end") * SLOTS / F.col("all")).cast("long").alias("stop"))
    rows = spans.where("stop > first").select("source", F.explode(F.sequence("first", F.col("stop") - 1)).alias("point"))
    rows = rows.select("source", _point(F.col("point")).alias("slot"))  # reversing is its own inverse
    extra = spans.where("stop <= first").select("source", (F.row_number().over(line) + (SLOTS - 1)).cast("long").alias("slot"))
    rank = Window.partitionBy("source").orderBy("slot")
    return rows.unionByName(extra).select("slot", "source", (F.row_number().over(rank) - 1).cast("long").alias("slot_rank"))


def blocks(targets: DataFrame, most: int = MOST_TIMES) -> DataFrame:
    """key, block, slot, begin, end: the schedule's slots with the tokens of their source's line that they take, and owed, the source's last."""
    key = _key(F.col("source"))
    owed = targets.select(key.alias("key"), F.least(F.round("target"), F.col("source_size") * F.lit(most)).cast("long").alias("owed"))
    slots = schedule(targets).select(key.alias("key"), "slot", F.col("slot_rank").alias("block"))
    counts = slots.groupBy("key").agg(F.count(F.lit(1)).alias("slots"))
    at = lambda k: F.floor(k.cast("decimal(38,0)") * F.col("owed") / F.col("slots")).cast("long")
    rows = slots.join(owed.join(counts, "key"), "key").where("owed > 0")
    return rows.select("key", "block", "slot", at(F.col("block")).alias("begin"), at(F.col("block") + 1).alias("end"), "owed", "slots")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("~"))


def _order(docs: DataFrame) -> Column:
    """A uniform, reproducible order of rows, by id and text, so that rows without ids are dealt out too."""
    return F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(":"), F.md5(text_of(docs))))


def mix(docs: DataFrame, keep: list[str], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """Each row of docs (doc_id, text, source) with what the mix takes of it.

    Returns row (a struct of the columns in keep), size, source_size, target, taken, and slots: for each time that the source's line
    reaches the document, the slot whose block holds its first word of that time. A null text has size 0; a null source is a source, the
    last. A source without words has target 0. Repeated rows lie side by side in any order. An empty table gives no rows. Columns
    may have any names; a very long text is cut by as many blocks as it takes.
    """
    size = F.size(split_words(text_of(docs))).cast("long")
    rows = docs.select(F.struct(*(docs[c] for c in keep)).alias("row"), docs["source"].alias("source"), size.alias("size"), _key(docs["source"]).alias("key"), _order(docs).alias("order"))
    rows = rows.withColumn("range", F.substring("order", 1, RANGE_DIGITS))
    sizes = written(rows.groupBy("source", "key", "range").agg(F.sum("size").alias("sum")), "mix-sizes")
    targets = written(source_targets(sizes.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, most), "mix-targets")
    plan = written(blocks(targets, most), "mix-blocks")
    per_source = targets.select(_key(F.col("source")).alias("key"), "source_size", "target").join(plan.groupBy("key").agg(F.first("owed").alias("owed"), F.first("slots").alias("n_slots")), "key", "left")
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("key", "range", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before")).join(per_source, "key")

    line = Window.partitionBy("key", "range").orderBy("order", "size")
    inside = line.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.drop("source").withColumns({"start": F.coalesce(F.sum("size").over(inside), F.lit(0)), "place": F.row_number().over(line)})
    rows = rows.join(starts, ["key", "range"]).withColumn("start", F.col("start") + F.col("before"))

    def block_of(token: Column) -> Column:
        """The last block that begins at or before a token: block k begins at floor(k * owed / slots)."""
        return F.floor(((token + 1).cast("decimal(38,0)") * F.col("n_slots") - 1) / F.col("owed")).cast("long")

    def of_turn(turn: Column) -> Column:
        first = F.col("start") + turn * F.col("source_size")
        last = F.least(first + F.col("size"), F.col("owed"))
        cut = F.transform(F.sequence(block_of(first), block_of(last - 1)), lambda k: F.struct(turn.alias("turn"), k.alias("block"), first.alias("first"), last.alias("last")))
        return F.when(last > first, cut).otherwise(F.array().cast("array<struct<turn:int,block:bigint,first:bigint,last:bigint>>"))

    parts = rows.where((F.col("owed") > 0) & (F.col("size") > 0))
    parts = parts.select("key", "range", "place", F.explode(F.flatten(F.transform(F.array(*map(F.lit, range(most))), of_turn))).alias("part")).select("key", "range", "place", "part.*")
    plan = plan.select("key", "block", "slot", "begin", "end")
    plan = F.broadcast(plan) if plan.count() <= 2 * SLOTS else plan
    held = F.least("last", "end") - F.greatest("first", "begin")
    begun = F.when((F.col("begin") <= F.col("first")) & (F.col("first") < F.col("end")), F.struct("turn", "slot"))
    got = parts.join(plan, ["key", "block"]).groupBy("key", "range", "place").agg(F.sum(held).alias("taken"), F.array_sort(F.collect_list(begun)).alias("turns"))
    rows = rows.join(got, ["key", "range", "place"], "left")
    slots = F.coalesce(F.transform("turns", lambda t: t["slot"]), F.array().cast("array<bigint>"))
    return rows.select("row", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), slots.alias("slots"))


def in_order(docs: DataFrame) -> DataFrame:
    """The mix: each row of docs as often as mix() takes its words, to the nearest whole number, in the order of the schedule.

    The rows are dealt out by ranges of slots, and sorted inside these, so the files of a written table follow the schedule. Columns are those
    of docs, whatever their names; texts without words are not in the mix. Nulls, repeated rows and empty tables as in mix().
    """
    mixed = mix(docs, docs.columns)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    dealt = mixed.select("row", F.explode(F.slice("slots", 1, F.least(times, F.size("slots")))).alias("slot"))
    return dealt.repartitionByRange("slot").sortWithinPartitions("slot").select("row.*")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """The digest of mix() over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs, ["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken", F.get("slots", F.lit(0)).alias("first_slot"))


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS o, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source
), fill AS (
  SELECT CAST([] AS VARCHAR[]) AS full_, 0 AS round, (SELECT CAST(sum(source_size) AS DOUBLE) / sum(weight) FROM s) AS per
  UNION ALL
  SELECT f2, round + 1, CASE WHEN len(f2) = (SELECT count(*) FROM s) THEN 0 ELSE
    (SELECT CAST(sum(source_size) AS DOUBLE) FROM s) END
  FROM (SELECT round, per, full_, (SELECT list(coalesce('=' || source, '~')) FROM s, (SELECT 1)
        WHERE list_contains(full_, coalesce('=' || source, '~'))
           OR 3 * source_size * (SELECT sum(weight) FROM s WHERE NOT list_contains(full_, coalesce('=' || source, '~')))
              < weight * ((SELECT sum(source_size) FROM s) - coalesce((SELECT sum(3 * source_size) FROM s WHERE list_contains(full_, coalesce('=' || source, '~'))), 0))) AS f2 FROM fill)
  WHERE len(coalesce(f2, [])) > len(full_)
), last AS (
  SELECT full_ FROM fill ORDER BY round DESC LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN list_contains(full_, coalesce('=' || source, '~')) THEN CAST(3 * source_size AS DOUBLE) ELSE
    CAST(weight * ((SELECT sum(source_size) FROM s) - coalesce((SELECT sum(3 * source_size) FROM s WHERE list_contains(full_, coalesce('=' || source, '~'))), 0)) AS DOUBLE)
      / (SELECT sum(weight) FROM s WHERE NOT list_contains(full_, coalesce('=' || source, '~'))) END AS target
  FROM s, last
), owed AS (
  SELECT *, CAST(least(round(target), 3 * source_size) AS BIGINT) AS owed, coalesce('=' || source, '~') AS k,
    CAST(sum(round(target)) OVER (ORDER BY source ASC NULLS LAST) AS HUGEINT) AS stop_, CAST(sum(round(target)) OVER () AS HUGEINT) AS every FROM t
), pts AS (
  SELECT n AS slot, list_sum(list_transform(range(0, 16), lambda b: ((n >> b) & 1) << (15 - b))) AS point FROM range(0, 65536) r(n)
), slots AS (
  SELECT slot, k, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS r FROM (
    SELECT slot, k FROM pts JOIN owed ON point * every >= (stop_ - CAST(round(target) AS HUGEINT)) * 65536 AND point * every < stop_ * 65536
    UNION ALL
    SELECT 65535 + row_number() OVER (ORDER BY source ASC NULLS LAST), k FROM owed WHERE round(target) > 0
      AND NOT EXISTS (SELECT 1 FROM pts WHERE point * every >= (stop_ - CAST(round(target) AS HUGEINT)) * 65536 AND point * every < stop_ * 65536))
), blocks AS (
  SELECT k, slot, r * owed // n AS b, (r + 1) * owed // n AS e FROM slots JOIN (SELECT k, count(*) AS n FROM slots GROUP BY k) USING (k) JOIN (SELECT k, CAST(owed AS HUGEINT) AS owed FROM owed) USING (k)
), line AS (
  SELECT doc_id, size, source_size, target, owed, k, row_number() OVER () AS id, coalesce(sum(size) OVER (PARTITION BY k ORDER BY o, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN owed ON d.source IS NOT DISTINCT FROM owed.source
), turns AS (
  SELECT id, k, turn, start + turn * source_size AS f, least(start + turn * source_size + size, owed) AS l FROM line, range(0, 3) t(turn) WHERE size > 0
), took AS (
  SELECT id, sum(least(l, e) - greatest(f, b)) AS taken, min(CASE WHEN b <= f AND f < e THEN slot + 1000000 * turn END) % 1000000 AS first_slot
  FROM turns JOIN blocks ON turns.k = blocks.k AND f < e AND b < l GROUP BY id
)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(first_slot AS BIGINT) AS first_slot FROM line LEFT JOIN took USING (id)
"""
