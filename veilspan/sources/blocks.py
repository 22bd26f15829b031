"""Blocks: the unit that is searched. From plain texts, one block a line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_block


def text_blocks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, block_id, block_seq, type, text: the normalized lines of each text.

    Empty lines are dropped but numbered, as in documents. A null text has no blocks.
    """
    lines = docs.select(F.col(id_column).alias("doc_id"), F.posexplode(F.split(text_column, "\n", -1)).alias("block_seq", "_line"))
    out = lines.select("doc_id", F.concat(F.lit("paragraph_"), F.col("block_seq")).alias("block_id"), "block_seq", F.lit("paragraph").alias("type"), normalize_block(F.col("_line")).alias("text"))
    return out.where("text != ''")


def whole_blocks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, block_id, block_seq, type, text: each text as one block, as it is."""
    return docs.select(F.col(id_column).alias("doc_id"), F.lit("paragraph_0").alias("block_id"), F.lit(0).alias("block_seq"), F.lit("paragraph").alias("type"), F.coalesce(text_column, F.lit("")).alias("text"))


def header_echo(blocks: DataFrame) -> DataFrame:
    """blocks with hf_matches: the header and footer texts of the same document that a paragraph or cell contains, with their source."""
    marks = blocks.where(F.col("type").isin("header", "footer") & (F.col("text") != "")).select("doc_id", F.col("type").alias("source"), F.col("text").alias("hf"))
    marks = marks.distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("source", F.col("hf").alias("text")))).alias("_marks"))
    out = blocks.join(marks, "doc_id", "left")
    inside = F.filter("_marks", lambda m: F.contains(F.col("text"), m["text"]))
    none = F.array().cast("array<struct<source:string,text:string>>")
    return out.withColumn("hf_matches", F.when(F.col("type").isin("header", "footer"), none).otherwise(F.coalesce(inside, none))).drop("_marks")


def walk(blocks: DataFrame) -> DataFrame:
    """doc_id, paragraphs, tables, headers, footers: the texts of each document's blocks by kind, in order; kinds that it lacks are empty."""
    kinds = {"paragraphs": ("paragraph", "sdt"), "tables": ("table_cell", "table"), "headers": ("header",), "footers": ("footer",)}
    place = F.struct("block_seq", "block_id", "text")
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("type").isin(*types), place))), lambda x: x["text"]).alias(name) for name, types in kinds.items()]
    return blocks.groupBy("doc_id").agg(*lists)
