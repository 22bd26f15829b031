"""Combination of detections: unions, interval anti-joins, dedup and replicate, selections, metadata matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import content_hash, grams
from .extract import not_overlapping

BLOCK = ["doc_id", "block_id"]


def union_all(rules: DataFrame, language: DataFrame) -> DataFrame:
    """Both, with their source, without dedup."""
    return rules.withColumn("source", F.lit("Rule Engine")).unionByName(language.withColumn("source", F.lit("NLP Service")), allowMissingColumns=True)


def prefer_language(rules: DataFrame, language: DataFrame, threshold: float = 0.5) -> DataFrame:
    """All language detections, and of the rules' those that none of these overlaps by the threshold."""
    return union_all(not_overlapping(rules, language, threshold), language)


def once_for_equal_texts(blocks: DataFrame, detect: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """detect() over one block of each text, its detections copied to all blocks of that text.

    Blocks without text have none. detect() must depend on the text alone. Worth its join where texts repeat; a text that many
    blocks share is detected once, and only its detections are copied.
    """
    keyed = blocks.withColumn("_key", F.md5("text")).where(F.trim("text") != "")
    one = keyed.groupBy("_key").agg(F.first("text").alias("text")).select(F.lit(0).alias("doc_id"), F.col("_key").alias("block_id"), "text")
    found = detect(one).drop("doc_id").withColumnRenamed("block_id", "_key")
    return keyed.select(*BLOCK, "_key").join(found, "_key").drop("_key")


def dedup_ratio(blocks: DataFrame, batch: int = 50) -> DataFrame:
    """with_text, unique_texts, dedup_percent, batches of blocks; the percent is null without any text."""
    rows = blocks.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("_h", content_hash(F.col("text")))
    out = rows.groupBy("_h").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("with_text"), F.count(F.lit(1)).alias("unique_texts"))
    share = F.try_divide(F.col("with_text") - F.col("unique_texts"), F.col("with_text")) * 100
    return out.withColumns({"dedup_percent": F.round(share, 4), "batches": F.ceil(F.col("unique_texts") / batch)})


def with_block(detections: DataFrame, blocks: DataFrame) -> DataFrame:
    """Detections with their block's text; those of unknown blocks go."""
    return detections.join(blocks.select(*BLOCK, F.col("text").alias("block_text")), BLOCK)


def selected(items: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chosen items of known blocks, and those of unknown ones.

    Of items with equal block, value, start and end the first (by item) stays; a missing category is `unknown`.
    """
    first = Window.partitionBy(*BLOCK, "original_value", "start", "end").orderBy("item")
    items = items.withColumn("category", F.coalesce("category", F.lit("unknown")))
    known, unknown = items.join(blocks.select(*BLOCK), BLOCK, "left_semi"), items.join(blocks.select(*BLOCK), BLOCK, "left_anti")
    return known.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"), unknown


def approved(items: DataFrame) -> DataFrame:
    return items.where(F.coalesce("approved", F.lit(False)))


def approve_all(items: DataFrame, value: bool = True) -> DataFrame:
    return items.withColumn("approved", F.lit(value))


def with_comments(items: DataFrame, comments: DataFrame) -> DataFrame:
    """items with the comment given for their item, the last if several."""
    last = comments.groupBy("item").agg(F.max_by("comment", "ord").alias("comment"))
    return items.drop("comment").join(last, "item", "left")


def header_metadata(items: DataFrame) -> DataFrame:
    """Each item of a header or footer for each section of the metadata."""
    rows = items.where(F.col("block_id").startswith("header_") | F.col("block_id").startswith("footer_"))
    return rows.withColumn("section", F.explode(F.array(*map(F.lit, ("core", "app", "custom")))))


def metadata_matches(properties: DataFrame, replacements: DataFrame) -> DataFrame:
    """Properties (doc_id, section, property, value) that hold a replaced value of their document.

    An equal value has confidence 1 (its last replacement counts); else one that contains originals of three characters or more 0.8,
    with the uuid and category of the first and all of them in partial_matches. Replacements: doc_id, ord, original_value, uuid, category.

    Values are listed under their runs of three characters; an original is looked up by the run of its own that fewest values of its document have, and only
    there compared, so values and originals of a document are never paired off.
    """
    equal = replacements.groupBy("doc_id", F.col("original_value").alias("value")).agg(F.max_by("uuid", "ord").alias("uuid"), F.max_by("category", "ord").alias("category"))
    exact = properties.join(equal, ["doc_id", "value"]).withColumns({"confidence": F.lit(1.0), "partial_matches": F.lit(None).cast("array<string>")})
    rest = properties.join(equal.select("doc_id", "value"), ["doc_id", "value"], "left_anti")
    listed = rest.select("doc_id", "section", "property", "value", F.explode(grams(F.col("value"))).alias("gram"))
    often = listed.groupBy("doc_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    originals = replacements.groupBy("doc_id", "original_value").agg(F.min(F.struct("ord", "uuid", "category")).alias("first"))
    own = originals.withColumn("gram", F.explode(grams(F.col("original_value")))).join(often, ["doc_id", "gram"], "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least")
    anchors = own.groupBy("doc_id", "original_value", "first").agg(rarest).where("least.n > 0")  # a run that no value has rules the original out
    anchors = anchors.select("doc_id", "original_value", "first.*", F.col("least.gram").alias("gram"))
    part = listed.join(anchors, ["doc_id", "gram"]).where(F.contains("value", F.col("original_value")))
    part = part.groupBy("doc_id", "section", "property", "value").agg(
        F.min_by("uuid", "ord").alias("uuid"), F.min_by("category", "ord").alias("category"), F.array_sort(F.collect_set("original_value")).alias("partial_matches")
    )
    return exact.unionByName(part.withColumn("confidence", F.lit(0.8)))


def report_with_metadata(document: DataFrame, metadata: DataFrame) -> DataFrame:
    """Replacements of the document, and those of the metadata whose value the document's don't have."""
    return document.unionByName(metadata.join(document.select("doc_id", "original_value").distinct(), ["doc_id", "original_value"], "left_anti"), allowMissingColumns=True)


def contained(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, item_id of documents that contain a passage as a whole.

    Of a passage of three words or more, the longest inner word is a word of the document too: documents' distinct words are joined with it,
    and only documents that have it are searched. The words of shorter passages may be cut out of longer ones, so the first letters (three at
    most) of their longest word are joined with the parts of documents' words. Passages without words are in no document.
    """
    words = lambda c: F.array_remove(F.split(c, r"[\x20\x09-\x0D]+"), "")
    inner = lambda c: F.slice(words(c), F.lit(2), F.greatest(F.size(words(c)) - 2, F.lit(0)))
    longest = lambda c: F.array_max(F.transform(c, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = passages.select("item_id", F.col("text").alias("passage"), longest(inner(F.col("text"))).alias("word"), F.substring(longest(words(F.col("text"))), 1, 3).alias("part"))
    distinct = F.array_distinct(words(F.col("text")))
    by_word = docs.select("doc_id", F.explode(distinct).alias("word")).join(keyed.where("word is not null").drop("part"), "word")

    def parts(w: Column) -> Column:
        of = lambda n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
        return F.concat(of(1), of(2), of(3))

    by_part = docs.select("doc_id", F.explode(F.array_distinct(F.flatten(F.transform(distinct, parts)))).alias("part")).join(keyed.where("word is null and part is not null").drop("word"), "part")
    place = by_word.select("doc_id", "item_id", "passage").unionByName(by_part.select("doc_id", "item_id", "passage"))
    return docs.join(place, "doc_id").where(F.contains(F.col("text"), F.col("passage"))).select("doc_id", "item_id")
