"""SimHash near-duplicates by an index of fingerprint bytes.

Two fingerprints that differ in at most REACH bits agree in all bytes but REACH. The eight byte positions are taken as four
pairs, so such fingerprints agree in two pairs at least, and the index has a posting list for each two pairs and their four
bytes. Members of a list are compared once: their shared positional bytes are tallied, pairs with fewer than 8 - REACH are
dropped, and the rest are verified bit by bit. Exact copies are one fingerprint throughout.

Lists of over HOT fingerprints are split by more of their bytes: their members agree in six positions or more with whatever is near them, so they
are listed under each six positions, and the shorter of these lists are tallied and verified in the same way. What is left are members
that are equal but for two bytes and crowd there (over HOT of 65,536 values). These aren't paired off: each is sent to itself and its 64
neighbours at one bit; all that meet at a place are within two bits of each other, and two within two bits meet somewhere, so linking
each to the smallest at the place gives the same components with rows in proportion to the members.

Components are found by alternating large-star and small-star steps over links between fingerprints, each step written
to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

REACH, SHINGLE, SEED = 2, 3, 42
#: Longer posting lists are split, and what can't be is linked through neighbours.
HOT = 64
#: The byte positions of the index's lists, and of those that long lists are split into.
FOUR = tuple((2 * i, 2 * i + 1, 2 * j, 2 * j + 1) for i, j in combinations(range(4), 2))
SIX = tuple(combinations(range(8), 8 - REACH))
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text: bytes, length: int) -> list[bytes]:
    """Runs of `length` words of the lower-cased text, joined by spaces; the whole sequence if there are fewer words."""
    words = text.translate(_LOWER).split()
    if len(words) <= length:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(length)), strict=False)))


def _majority(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes, as a signed integer."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, length: int = SHINGLE) -> int:
    """0 for a text without words."""
    parts = shingles(text, length)
    hash_ = xxhash.xxh64_intdigest
    return _majority(np.fromiter((hash_(s, SEED) for s in parts), np.uint64, len(parts))) if parts else 0


def fingerprints(docs: DataFrame, length: int = SHINGLE) -> DataFrame:
    """doc_id, fp of each row of docs; the texts go to Python in Arrow batches, one text at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            prints = [fingerprint(t.as_buffer().to_pybytes(), length) if t.is_valid else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))


def _shared_bytes(a: Column, b: Column) -> Column:
    return sum(((_byte(a, i) == _byte(b, i)).cast("int") for i in range(8)), F.lit(0))


def _linked(a: Column, b: Column) -> Column:
    """Count filter, then verification."""
    return (_shared_bytes(a, b) >= 8 - REACH) & (F.bit_count(a.bitwiseXOR(b)) <= REACH)


def _postings(prints: DataFrame, places: tuple[tuple[int, ...], ...]) -> DataFrame:
    """which, bytes, fp: each fingerprint under each choice of byte positions."""

    def entry(which: int, positions: tuple[int, ...]) -> Column:
        value = F.lit(0).cast("long")
        for i in positions:
            value = F.shiftleft(value, 8).bitwiseOR(_byte(F.col("fp"), i))
        return F.struct(F.lit(which).alias("which"), value.alias("bytes"))

    entries = F.array(*(entry(k, p) for k, p in enumerate(places)))
    return prints.select("fp", F.explode(entries).alias("e")).select("e.which", "e.bytes", "fp")


def _tallied(prints: DataFrame, places: tuple[tuple[int, ...], ...], hot: int, name: str) -> tuple[DataFrame, DataFrame]:
    """a, b: pairs of members of the lists of up to `hot` that pass the count filter and verification; and fp of members of longer lists."""
    postings = written(_postings(prints, places), f"{name}-postings")
    key = ["which", "bytes"]
    sizes = written(postings.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"{name}-sizes")
    few = postings.join(sizes.where(F.col("n") <= hot).select(*key), key, "left_semi")
    x, y = few.alias("x"), few.alias("y")
    met = (F.col("x.which") == F.col("y.which")) & (F.col("x.bytes") == F.col("y.bytes")) & (F.col("x.fp") < F.col("y.fp"))
    pairs = x.join(y, met & _linked(F.col("x.fp"), F.col("y.fp"))).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    many = postings.join(sizes.where(F.col("n") > hot).select(*key), key, "left_semi").select("fp").distinct()
    return pairs, many


def links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """a, b: links between the distinct fingerprints in prints (fp) that join what is within REACH bits."""
    pairs, many = _tallied(prints, FOUR, hot, "simhash")
    many = written(many, "simhash-many")
    if many.isEmpty():
        return pairs.distinct()
    split, crowded = _tallied(many, SIX, hot, "simhash-split")
    near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(np.int64(np.uint64(1) << np.uint64(i)).item())) for i in range(64)))
    places = crowded.select("fp", F.explode(near).alias("place"))
    least = places.groupBy("place").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("place", "a")
    stars = places.join(least, "place").where("fp > a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(split).unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for the nodes of edges (a, b)."""
    state = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "components")
    mark = None
    while True:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        small = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(small, "b")
        new = joined.select(F.col("m").alias("a"), "b").unionByName(joined.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a < b").distinct()
        state = written(new, "components")
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == now:
            break
        mark = now
    return state.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(state.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, length: int = SHINGLE, link: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of the component) of each row of docs (doc_id, text).

    Null and empty texts have fingerprint 0, linked like any other. Repeated rows are copies. A null doc_id counts only where no
    other id is in the component. An empty table gives no rows. Other columns are not read.
    """
    prints = written(fingerprints(docs, length), "simhash-prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(link(nodes.select("fp"))).withColumnRenamed("node", "fp")
    nodes = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(nodes.select("fp", "root").join(ids, "root").drop("root"), "fp")


def op3_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """near_duplicates() over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
