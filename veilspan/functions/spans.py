"""Matches of a pattern with their offsets, as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

SPAN = "struct<start:int,end:int,value:string>"
#: Marks the ends of matches; in the text it is first exchanged for another private-use character, so lengths stay.
_MARK, _OTHER = "\uE000", "\uE001"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def unmarked(text: Column) -> Column:
    """The text as matches() cuts it; null counts as empty."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit(_MARK), F.lit(_OTHER))


def matches(text: Column, pattern: str | Column, clean: bool = False) -> Column:
    """Structs of start, end, value of all matches of a Java pattern, in code points, end exclusive.

    Matches are marked by one replacement and cut by one split, so the time is in proportion to the text whatever the number of
    matches (regexp_extract_all copies the text for each, and translate looks every character up). A pattern must not match the empty string.
    Of a text that many patterns are run on, unmarked() can be taken before (clean), once for all.
    """

    def step(a: Column, p: Column) -> Column:
        end = a["at"] + F.length(p)
        span = F.struct(a["at"].alias("start"), end.alias("end"), p.alias("value"))
        return F.struct(end.alias("at"), (~a["in"]).alias("in"), F.when(a["in"], F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("in"), no_spans().alias("out"))
    plain = text if clean else unmarked(text)
    parts = F.split(F.regexp_replace(plain, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    return let(parts, lambda p: F.when(F.size(p) > 1, F.aggregate(p, start, step, lambda a: a["out"])).otherwise(no_spans()))


def overlap_length(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))


def overlaps(a: Column, b: Column) -> Column:
    """Whether two spans share a character."""
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def overlap_ratio(a: Column, b: Column) -> Column:
    """The shared length over the shorter span's; 0 if one is empty or they are apart."""
    shorter = F.least(a["end"] - a["start"], b["end"] - b["start"])
    return F.when(shorter > 0, overlap_length(a, b) / shorter).otherwise(F.lit(0.0))
