"""Near copies of whole documents: SimHash by an index of fingerprint bytes, verified by exact Jaccard similarity over word shingles.

A document is the set of its shingles, by 64-bit hash; documents with equal sets are one node. A node has a fingerprint of 64 * WORDS bits over
its runs of RUN words, repeats included, so BYTES bytes at BYTES positions. Two fingerprints that differ in at most SURE bits agree in
BYTES - SURE of their bytes at least, the guaranteed minimum SHARED.

The index has a posting list for each of a fixed choice of byte positions and the bytes there. Positions are taken in threes, so that a list has few
members by chance up to 2^24 nodes; beyond, one more for each 256 times as many nodes, in as many more lists as keep the chance alike that a pair meets (see places()).
A posting carries a word of the fingerprint that is none of its list's, and members of a list are compared where they share a byte of it. The
shared positional bytes of pairs are tallied, pairs with fewer than SHARED are dropped, and the rest are verified by their whole sets.
What meets in no list is not found: tests measure the recall by pairs at a similarity of 0.8 (NEAR) and more.

Members of lists of over HOT are first verified with a centre of their list, the member that stands in most long lists: in the lists of one
shuffle of the positions, in which a node stands a few times, and then in the other lists for those members that aren't in their centre's component by then. So a group of
near copies is joined in its first lists and isn't met again in the others. Then, in lists of any length, only members whose components still differ are paired, in long lists only if their
sketches let them be near, so that a large group of near copies isn't paired off, and each pair that meets is verified, dropped by a filter that no near pair
fails, or in one component already.

Before whole sets are compared, pairs are dropped whose sketches differ in more places than near sets can: a sketch is, for each of 64 * SKETCH
places, whether an odd number of hashes fall there, so a shingle that only one set has changes one place.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import fresh, text_of, written
from .simhash import _LOWER, SEED, components
from .textbytes import mixed

#: The least similarity is NEAR[0] / NEAR[1].
SHINGLE, NEAR = 5, (4, 5)
#: The words of a run, and the 64-bit words of a fingerprint.
RUN, WORDS = 2, 8
BYTES = 8 * WORDS
#: Bits up to which fingerprints are sure to share the least number of bytes that a pair has to be verified.
SURE = 60
SHARED = BYTES - SURE
#: Positions that name a list of up to 2^24 nodes, and the lists of a node; with each more position, the lists are LISTS_TIMES as many.
POSITIONS, LISTS, LISTS_TIMES = 3, 192, 4
#: Members of longer lists are first compared with one member.
HOT = 4
#: The words of a sketch.
SKETCH = 16
#: Ids and hashes of rows to drop or to read are broadcast up to this number (16 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 500_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _words(text: bytes) -> np.ndarray:
    """Hashes of the words of the lower-cased text."""
    hash_ = xxhash.xxh64_intdigest
    words = text.translate(_LOWER).split()
    known = {w: hash_(w, SEED) for w in set(words)}
    return np.fromiter((known[w] for w in words), np.uint64, len(words))


def _runs(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the runs of `length` words, by their hashes; of the whole sequence if there are fewer words."""
    n = min(length, len(h))
    if not n:
        return h
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * _FACTOR + h[i : i + len(out)]
    return out ^ (out >> np.uint64(29))


def shingle_set(text: bytes, length: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of `length` words of the lower-cased text; of the whole sequence if there are fewer words."""
    return np.unique(_runs(_words(text), length))


def fingerprint(text: bytes) -> list[int]:
    """The SimHash of a text, WORDS signed integers; zeros for a text without words."""
    return _simhash(_words(text))


def _simhash(words: np.ndarray) -> list[int]:
    h = _runs(words, RUN)
    counts = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(h), 1 << 12):
        part = h[i : i + (1 << 12)]
        wide = np.stack([mixed(part + np.uint64(w * int(_FACTOR) % (1 << 64))) for w in range(WORDS)], 1)
        counts += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(h), bitorder="little").view(np.int64).tolist()


def places(nodes: int) -> list[tuple[int, ...]]:
    """The choices of byte positions that name the lists of so many nodes; each position stands in about as many of them.

    Positions are shuffled (by a fixed seed) and cut into choices, again and again, so that choices of one shuffle have no position in common.
    """
    size = POSITIONS
    while nodes > 256**size:
        size += 1
    rng, out, lists = random.Random(SEED), [], LISTS * LISTS_TIMES ** (size - POSITIONS)
    while len(out) < lists:
        order = rng.sample(range(BYTES), BYTES)
        out += [tuple(order[i : i + size]) for i in range(0, BYTES - size + 1, size)]
    return out[:lists]


def sketch(shingles: np.ndarray) -> np.ndarray:
    odd = np.bincount((shingles >> np.uint64(8)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(docs: DataFrame, length: int, whole: bool) -> DataFrame:
    """The columns of docs but text, and fp, n, sketch of each row; and all its shingles (whole), or its simhash."""
    carried = [f for f in docs.schema if f.name != "text"]
    longs = T.ArrayType(T.LongType())
    made = [T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sketch", longs), T.StructField("shingles" if whole else "simhash", longs)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes, sketches, lists = [], [], [], []
            for t in batch.column("text").cast(pa.large_binary()):
                words = _words(t.as_buffer().to_pybytes() if t.is_valid else b"")
                s = np.unique(_runs(words, length))
                prints.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                sizes.append(len(s))
                sketches.append(sketch(s))
                lists.append(s.view(np.int64) if whole else np.array(_simhash(words), np.int64))
            arrays = [pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), _listed(sketches), _listed(lists)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in carried), *arrays], [f.name for f in [*carried, *made]])

    return docs.mapInArrow(rows, T.StructType([*carried, *made]))


def _listed(lists: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in lists])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*lists, np.zeros(0, np.int64)])))


def _alike(x: Column, y: Column, n: Column) -> Column:
    """Whether two sketches differ in no more places than those of near sets with n shingles together can: these share 2 * least / (least + most)."""
    least, most = NEAR
    places = sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(SKETCH)), F.lit(0))
    return (least + most) * places <= (most - least) * n


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, length: int) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity, by the texts of docs (doc_id, t, text)."""
    least, most = NEAR
    pairs = written(pairs, "neardup-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(nodes.select("fp", "least"), "fp")
    wanted = written(wanted.select("least.doc_id", "least.t").distinct(), "neardup-wanted")
    texts = _marked(docs, wanted, "left_semi").select("text")
    sets = _sets(texts, length, True).groupBy("fp").agg(F.min("shingles").alias("s"))
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("fp").alias("b"), F.col("s").alias("sb")), "b")
    near = (least + most) * F.size(F.array_intersect("sa", "sb")) >= least * (F.size("sa") + F.size("sb"))
    return written(both.where(near).select("a", "b"), "neardup-links")


def _postings(nodes: DataFrame, chosen: list[tuple[int, ...]]) -> DataFrame:
    """name, fp, word: each node (fp, simhash) in its lists; a name is a choice of positions and the bytes there, word an other_word()."""
    word = lambda i: F.get("simhash", F.shiftright(i, 3))
    size = len(chosen[0])
    positions = F.array(*(F.lit(i) for c in chosen for i in c))
    bytes_ = F.transform(F.sequence(F.lit(0), F.lit(BYTES - 1)), lambda i: F.call_function("shiftrightunsigned", word(i), 8 * (i % 8)).bitwiseAND(F.lit(255)))
    others = F.array(*(F.lit(other_word(k, c)) for k, c in enumerate(chosen)))
    rows = nodes.select("fp", "simhash", bytes_.alias("bytes"))

    def name(k: Column) -> Column:
        value = k.cast("long")
        for j in range(size):
            value = F.shiftleft(value, 8).bitwiseOR(F.get("bytes", F.get(positions, k * size + j)))
        return F.struct(value.alias("name"), F.get("simhash", F.get(others, k)).alias("word"))

    rows = rows.select("fp", F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(chosen) - 1)), name)).alias("p"))
    return rows.select("fp", "p.name", "p.word")


def other_word(k: int, positions: tuple[int, ...]) -> int:
    """A word of the fingerprint in which none of the positions lies, another one for each k."""
    free = [w for w in range(WORDS) if all(i // 8 != w for i in positions)]
    return free[k % len(free)]


def _differing(a: Column, b: Column) -> Column:
    """In how many bytes two words differ: the bits of each byte of their difference are gathered in its lowest, which are counted."""
    apart = a.bitwiseXOR(b)
    for k in (4, 2, 1):
        apart = apart.bitwiseOR(F.shiftrightunsigned(apart, k))
    return F.bit_count(apart.bitwiseAND(F.lit(0x0101010101010101)))


def _shared(x: str, y: str) -> Column:
    """How many positional bytes two fingerprints share."""
    return F.lit(BYTES) - sum((_differing(F.get(x, F.lit(w)), F.get(y, F.lit(w))) for w in range(WORDS)), F.lit(0))


def _counted(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that pass the count filter."""
    left, right = (nodes.select(F.col("fp").alias(side), F.col("simhash").alias(f"h{side}")) for side in "ab")
    return pairs.join(left, "a").join(right, "b").where(_shared("ha", "hb") >= SHARED).select("a", "b")


def members(nodes: DataFrame, nodes_count: int) -> DataFrame:
    """name, fp, word, size: the members of lists of two or more. One shuffle deals the postings out, and lists of one are dropped there."""
    return _postings(nodes, places(nodes_count)).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("name"))).where("size > 1")


def _touching(a: Column, b: Column) -> Column:
    return _differing(a, b) < 8


def first_lists(nodes_count: int) -> Column:
    """Whether a list is named by a choice of the first shuffle of places(), which have no position in common."""
    size = len(places(nodes_count)[0])
    return F.shiftrightunsigned("name", 8 * size) < BYTES // size


def _near(a: str, b: str) -> Column:
    """Whether two members (structs of fp, word, root, n, sketch) are in different components, share a byte of their words and have sketches of sets that may be near."""
    of = lambda c: (F.col(f"{a}.{c}"), F.col(f"{b}.{c}"))
    (x, y), (n, m) = of("root"), of("n")
    return (x != y) & _touching(*of("word")) & _alike(*of("sketch"), n + m)


def _member() -> Column:
    return F.struct("fp", "word", "root", "n", "sketch")


def stars(rows: DataFrame) -> DataFrame:
    """a, b: each member (name, fp, word, root, n, sketch) with its list's centre: the more lists a node is in, the more of it is common to the group."""
    standing = rows.withColumn("places", F.count(F.lit(1)).over(Window.partitionBy("fp")))
    centre = standing.groupBy("name").agg(F.max_by(_member(), F.struct("places", "fp")).alias("c"))
    pairs = rows.select("name", _member().alias("m")).join(centre, "name").where(_near("m", "c"))
    return pairs.select(F.least("m.fp", "c.fp").alias("a"), F.greatest("m.fp", "c.fp").alias("b")).distinct()


def unsettled(listed: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """name, fp, word, size, root, n, sketch of the members of lists; lists with one component by roots (node, root) are passed over."""
    rows = listed.select("name", "fp", "word", "size").join(_rooted(nodes.select("fp", "n", "sketch"), roots), "fp")
    open_ = rows.groupBy("name").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("name")
    return written(rows.join(open_, "name", "left_semi"), "simhash-open")


def apart(rows: DataFrame) -> DataFrame:
    """a, b: pairs of members of a list (name, fp, word, root, n, sketch) whose components differ."""
    x, y = (rows.select("name", _member().alias(side)) for side in "xy")
    met = x.join(y, (x["name"] == y["name"]) & (F.col("x.fp") < F.col("y.fp")) & _near("x", "y"))
    return met.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes with the root of their component, by roots (node, root)."""
    roots = roots.select(F.col("node").alias("fp"), F.col("root").alias("_root"))
    return nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("_root", "fp")).drop("_root")


def links(docs: DataFrame, nodes: DataFrame, length: int, hot: int = HOT) -> DataFrame:
    """a, b: links between nodes that meet in the index, pass the count filter and have the similarity; enough of them to join each component.

    nodes has fp, n, sketch, simhash and `least`, the doc_id and t of a row.
    """
    count, many = nodes.count(), F.col("size") > hot
    listed = written(members(nodes, count), "simhash-members")
    verify = lambda pairs: verified(_counted(pairs, nodes), docs, nodes, length)
    first = listed.where(many & first_lists(count)).join(nodes.select("fp", F.col("fp").alias("root"), "n", "sketch"), "fp")
    near = verify(stars(first))
    left = unsettled(listed, nodes, components(near))
    near = near.unionByName(verify(stars(left.where(many))))
    return near.unionByName(verify(apart(unsettled(left, nodes, components(near)))))


def near_duplicates(docs: DataFrame, length: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """doc_id, t, fp, component_id, is_first of each row of docs (doc_id, text): the smallest doc_id of its component, and whether the row has it.

    t is a hash of the text and fp one of its set of shingles. Texts without words have equal sets, so they are copies; so are repeated
    rows. Rows without an id come after all others: a component has a null id only if none of its rows has one. Rows that share an id
    are told apart by t, of which the smallest is first. An empty table gives no rows.
    """
    docs = docs.select("doc_id", F.xxhash64(text_of(docs)).alias("t"), "text")
    prints = written(_sets(docs, length, False), "neardup-prints")
    nodes = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")).alias("least"), *(F.first(c).alias(c) for c in ("n", "sketch")), F.min("simhash").alias("simhash"))
    nodes = written(nodes, "neardup-nodes")
    roots = components(links(docs, nodes, length, hot))
    nodes = _rooted(nodes.select("fp", "least"), roots)
    ids = nodes.groupBy("root").agg(F.min("least").alias("first"))
    out = prints.select("doc_id", "t", "fp").join(nodes.select("fp", "root").join(ids, "root"), "fp")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t") == F.col("first.t"))
    return out.select("doc_id", "t", "fp", F.col("first.doc_id").alias("component_id"), is_first.alias("is_first"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without near copies: of each component the row with the smallest doc_id (near_duplicates()), in docs' columns.

    Of rows that share that id and the text, the one with the smallest other columns stays. Ids and hashes of texts alone are joined to
    the texts, and are broadcast up to BROADCAST_IDS of them; rows are shuffled with their texts only where they are repeated. Columns may
    have any names.
    """
    found = written(near_duplicates(docs).select("doc_id", "t", "is_first"), "simhash-found")
    again = written(found.where("is_first").groupBy("doc_id", "t").count().where("count > 1").select("doc_id", "t"), "simhash-again")
    others = written(found.where("not is_first").select("doc_id", "t").distinct().unionByName(again), "simhash-others")
    t, row = fresh(docs, "t"), fresh(docs, "row")
    rows = docs.withColumn(t, F.xxhash64(text_of(docs)))
    order = sorted(c for c in docs.columns if c != "doc_id")
    best = _marked(rows, again, "left_semi", t).groupBy("doc_id", t).agg(F.min(F.struct(*order)).alias(row))
    best = best.select(*(F.col("doc_id") if c == "doc_id" else F.col(f"`{row}`.`{c}`").alias(c) for c in docs.columns))
    return _marked(rows, others, "left_anti", t).select(*docs.columns).unionByName(best)


def _marked(docs: DataFrame, keys: DataFrame, how: str, t: str = "t") -> DataFrame:
    """The rows of docs (doc_id, and t by its name) with or without a key (doc_id, t)."""
    keys = keys.select(F.col("doc_id").alias("_id"), F.col("t").alias("_hash"))
    if keys.count() <= BROADCAST_IDS:
        keys = F.broadcast(keys)
    return docs.join(keys, docs["doc_id"].eqNullSafe(keys["_id"]) & (docs[t] == keys["_hash"]), how)
