"""Spans near each other: intervals by bins, overlaps, and entities with the cue nearest to them.

A block is cut into bins of BIN characters. An interval stands in each bin that it touches, so what overlaps meets in a bin, and joins and sweeps go by
(document, block, bin): a long block is work for many tasks, and spans far apart are never compared. What meets in several bins is one result again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BIN = 256
KEY = ["doc_id", "block_id"]


def bins(start: Column, end: Column, width: int = 0) -> Column:
    """The bins that an interval, and `width` characters on either side, touch; an empty interval stands where it begins."""
    first = F.floor(F.greatest(start - width, F.lit(0)) / BIN)
    last = F.floor(F.greatest(end + width - (0 if width else 1), start) / BIN)
    return F.explode(F.sequence(first, F.greatest(first, last)))


def meeting(left: DataFrame, right: DataFrame, clash, keep_left: list[str], keep_right: list[str], use: list[str] = ()) -> DataFrame:
    """Distinct KEY, keep_left (as l_*) and keep_right (as r_*) of pairs of a block that share a bin and clash(l, r); both have start, end and `use`.

    Only what shares a character, or lies empty within the other, is sure to share a bin.
    """

    def side(rows: DataFrame, name: str, keep: list[str]) -> DataFrame:
        columns = dict.fromkeys([*keep, "start", "end", *use])
        return rows.select(*KEY, F.struct(*columns).alias(name)).withColumn("_bin", bins(F.col(f"{name}.start"), F.col(f"{name}.end")))

    both = side(left, "_l", keep_left).join(side(right, "_r", keep_right), [*KEY, "_bin"]).where(clash(F.col("_l"), F.col("_r")))
    return both.select(*KEY, *(F.col(f"_l.{c}").alias(f"l_{c}") for c in keep_left), *(F.col(f"_r.{c}").alias(f"r_{c}") for c in keep_right)).distinct()


def with_cues(entities: DataFrame, cues: DataFrame, width: int = 50) -> DataFrame:
    """Entities (KEY, category, start, end, ord, ...) that have a cue for their category (KEY, category, start, end, original_value) within `width` characters.

    cue, cue_start and distance (0 where they overlap) say which is nearest; of equally near ones that before the entity, then the one that ends later, or
    begins earlier behind it. One sorted sweep each way over a bin's entities and cues finds it, so entities and cues are never paired. ord tells the
    entities of a block apart. Entities without a cue near are left out, and so are those of categories without cues.
    """
    key = [*KEY, "category"]
    none = F.lit(None)
    whole = entities.na.drop(subset=[*key, "ord"]).withColumn("_e", F.struct(*entities.columns))  # goes along, so that entities are found once
    e = whole.select(*key, "start", "end", "ord", bins(F.col("start"), F.col("end"), width + 1).alias("_bin"), none.cast("string").alias("_cue"), "_e")
    c = cues.select(*key, "start", "end", none.cast("int").alias("ord"), bins(F.col("start"), F.col("end")).alias("_bin"), F.col("original_value").alias("_cue"), none.cast(whole.schema["_e"].dataType).alias("_e"))
    rows = e.withColumn("ord", F.col("ord").cast("long")).unionByName(c.withColumn("ord", F.col("ord").cast("long")))
    is_cue = F.col("_cue").isNotNull()
    span = lambda *k: F.when(is_cue, F.struct(*k, F.col("start").alias("s"), F.col("end").alias("e"), F.col("_cue").alias("v")))
    forth = Window.partitionBy(*key, "_bin").orderBy("start", F.col("_cue").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*key, "_bin").orderBy(F.col("start").desc(), F.col("_cue").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_b", F.max(span(F.col("end").alias("k"), (-F.col("start")).alias("j"))).over(forth)).withColumn("_a", F.min(span(F.col("start").alias("k"), F.col("end").alias("j"))).over(back))
    near = F.array(*(F.when(F.col(f"{n}.s").isNotNull(), F.struct(F.greatest(F.lit(0), F.col("start") - F.col(f"{n}.e"), F.col(f"{n}.s") - F.col("end")).alias("distance"), F.lit(i).alias("side"), F.col(f"{n}.s").alias("cue_start"), F.col(f"{n}.v").alias("cue"))) for i, n in enumerate(("_b", "_a"))))
    best = F.array_min(F.filter(near, lambda n: n.isNotNull()))
    found = rows.where(~is_cue).select(*key, "ord", "_e", best.alias("_n")).where(F.col("_n.distance") <= width)
    found = found.groupBy(*key, "ord").agg(F.min("_n").alias("_n"), F.first("_e").alias("_e"))
    return found.select("_e.*", F.col("_n.cue").alias("cue"), F.col("_n.cue_start").alias("cue_start"), F.col("_n.distance").alias("distance"))
