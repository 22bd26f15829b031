"""Rewriting: replacement of spans by identifiers, by position, and restoring from the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import matches
from ..functions.text import UUID_PATTERN, hash_uuid
from . import intervals

BLOCK = ["doc_id", "block_id"]


def with_uuid(detections: DataFrame, mode: str = "hash") -> DataFrame:
    """A uuid for each occurrence: `hash` makes it from place and category, `random` anew (write the result before using it twice)."""
    if mode not in ("hash", "random"):
        raise ValueError("mode is hash or random")
    made = hash_uuid(*(F.col(c) for c in (*BLOCK, "start", "end", "category"))) if mode == "hash" else F.uuid()
    return detections.withColumn("uuid", made)


def separable(detections: DataFrame) -> DataFrame:
    """detections with `success`: whether it overlaps none before it (by start, then ord) that is itself replaced."""
    kept = intervals.resolve(detections.select(*BLOCK, "ord", "start", "end"), intervals.left_to_right, *BLOCK)
    mark = kept.select(*BLOCK, "ord", F.lit(True).alias("success"))
    return detections.join(mark, [*BLOCK, "ord"], "left").withColumn("success", F.coalesce("success", F.lit(False)))


def _pieces(text: Column, spans: Column) -> Column:
    """The text with each span (by start, apart) replaced by its uuid."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), s["uuid"])).alias("out"))
    return F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))


def anonymized(blocks: DataFrame, replacements: DataFrame) -> DataFrame:
    """blocks with the spans of replacements (those with success, if they say) replaced by their uuids.

    Text is spliced by position, so equal values elsewhere stay; blocks without replacements stay as they are.
    """
    rows = replacements.where("success") if "success" in replacements.columns else replacements
    spans = rows.groupBy(*BLOCK).agg(F.array_sort(F.collect_list(F.struct("start", "end", "uuid"))).alias("_spans"))
    out = blocks.join(spans, BLOCK, "left")
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(_pieces(F.col("text"), F.col("_spans")))
    return out.withColumn("text", text).drop("_spans")


def restored(blocks: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """blocks with uuids replaced by the originals in table (uuid, original_value), and each uuid found with whether it was.

    Uuids are compared by case; unknown ones stay and count as failed.
    """
    rows = blocks.withColumn("_found", matches(F.col("text"), UUID_PATTERN))
    found = rows.where(F.size("_found") > 0).select(*BLOCK, F.explode("_found").alias("_f")).select(*BLOCK, "_f.start", "_f.end", F.col("_f.value").alias("uuid"))
    found = found.join(table.select("uuid", "original_value"), "uuid", "left").withColumn("success", F.col("original_value").isNotNull())
    spans = found.where("success").select(*BLOCK, "start", "end", F.col("original_value").alias("uuid"))
    return anonymized(rows.drop("_found"), spans), found


def properties_replaced(properties: DataFrame, matches_: DataFrame) -> DataFrame:
    """Properties with each matched original in their value replaced by the uuid: the whole value if equal, else the parts."""
    key = ["doc_id", "section", "property"]
    joined = properties.join(matches_.select(*key, "uuid", "confidence", "partial_matches"), key, "left")
    parts = F.aggregate(F.coalesce("partial_matches", F.array().cast("array<string>")), F.col("value"), lambda v, p: F.replace(v, p, F.col("uuid")))
    return joined.withColumn("value", F.when(F.col("confidence") == 1.0, F.col("uuid")).when(F.col("confidence").isNotNull(), parts).otherwise(F.col("value"))).drop("uuid", "confidence", "partial_matches")
