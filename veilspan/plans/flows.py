"""Whole flows: analyse, anonymise a selection or all that is found, restore."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import combine, extract, reports, rewrite
from ..sources.rules import Rule


def analyse(blocks: DataFrame, rules: Sequence[Rule], language: Sequence[Rule] = ()) -> DataFrame:
    """What is found for review: both kinds of detections, not deduplicated, with their source and block text."""
    return combine.with_block(combine.union_all(extract.scan(blocks, rules), extract.scan(blocks, language)), blocks)


def anonymise(blocks: DataFrame, rules: Sequence[Rule] = (), language: Sequence[Rule] = (), items: DataFrame | None = None, mode: str = "hash") -> dict[str, DataFrame]:
    """Blocks with the chosen items replaced, or all that is found where `items` is None; an empty selection replaces nothing.

    Returns blocks, replacements, table, ledger, statistics and skipped (items of unknown blocks). In random mode write the replacements
    before using them twice, as each use makes new ids.
    """
    if items is None:
        chosen = combine.prefer_language(extract.scan(blocks, rules), extract.scan(blocks, language))
        skipped = chosen.limit(0)
    else:
        known, skipped = combine.selected(items, blocks)
        chosen = known.withColumn("ord", F.col("item"))
        if "confidence" not in chosen.columns:
            chosen = chosen.withColumn("confidence", F.lit(1.0))
    marked = rewrite.separable(rewrite.with_uuid(_numbered(chosen), mode))
    done = marked.where("success")
    return {
        "blocks": rewrite.anonymized(blocks, marked),
        "replacements": marked,
        "table": reports.replacement_table(done),
        "ledger": reports.ledger(done),
        "statistics": reports.replacement_statistics(marked),
        "skipped": skipped,
    }


def _numbered(detections: DataFrame) -> DataFrame:
    """ord anew within each block, as detections of two sources may share numbers."""
    keys = [c for c in ("start", "end", "category", "source", "ord") if c in detections.columns]
    return detections.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id", "block_id").orderBy(*keys)))


def restore(blocks: DataFrame, table: DataFrame) -> dict[str, DataFrame]:
    """Blocks with the originals of the table (uuid, original_value) back in place, what was found, and the statistics."""
    done, found = rewrite.restored(blocks, table)
    return {"blocks": done, "found": found, "statistics": reports.restore_statistics(found)}
