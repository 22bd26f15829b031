"""Dictionaries of any size: an index of phrases by hashed pairs of tokens, joined with the tokens of texts and verified.

A phrase is a sequence of tokens (see tokens); it stands in a text where the same tokens do, in any case, with white space where the phrase has it, however
much. Every phrase has one key: the hash of its first two tokens, or of its only one. Each token of a text looks its two keys up (the token alone, and with its successor),
and brings along as many tokens as the longest phrase has, by which hits are verified exactly. So the cost of a text doesn't depend on the number of phrases.
Texts are cut, and these windows made, in Arrow batches; the lookup is a join.

An index of up to BROADCAST phrases is broadcast behind a count, and the scan of texts isn't shuffled; what phrases begin with goes to the tasks that cut texts
too, so that only tokens that begin like a phrase leave them. Beyond it the keys of all tokens are joined with salt, so that a frequent token isn't one task's.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.confidence import for_phrase
from . import intervals
from .tokens import Cut, cut, in_arrow, marked, tokens, word_of

#: Phrases that are broadcast at most; beyond, the join shuffles, with SALT parts of each key.
BROADCAST, SALT = 200_000, 16
#: Ends each token of a window; no token has it.
_END = "\uE000"


def _spelt(found: Column) -> Column:
    """Tokens in lower case, those after white space with a space before; е for ё."""
    return F.transform(found, lambda t: F.when(t["gap"] == "", word_of(t["text"])).otherwise(F.concat(F.lit(" "), word_of(t["text"]))))


def _key(parts: Column, n: int) -> Column:
    """The hash of the first n tokens; the first one's white space doesn't count."""
    head = F.ltrim(F.get(parts, F.lit(0)))
    return F.xxhash64(head) if n == 1 else F.xxhash64(head, F.get(parts, F.lit(1)))


def index(phrases: DataFrame) -> DataFrame:
    """key, parts, n, phrase, category, confidence of the distinct phrases (phrase, category, confidence), as match() takes them.

    Phrases without a token (null, empty, white space) are left out; of equal ones of a category, which spelling goes along isn't fixed but for its lowest order.
    """
    rows = phrases.select("phrase", "category", "confidence", _spelt(tokens(F.col("phrase"))).alias("parts")).where(F.size("parts") > 0)
    first = F.concat(F.array(F.ltrim(F.get("parts", F.lit(0)))), F.slice("parts", 2, F.size("parts")))
    rows = rows.withColumn("parts", first).groupBy("parts", "category").agg(F.min("phrase").alias("phrase"), F.max("confidence").alias("confidence"))
    n = F.size("parts")
    return rows.select(F.when(n == 1, _key(F.col("parts"), 1)).otherwise(_key(F.col("parts"), 2)).alias("key"), "parts", n.alias("n"), "phrase", "category", "confidence")


def match(blocks: DataFrame, phrases: DataFrame, method: str = "phrase_matcher") -> DataFrame:
    """Detections of all phrases (phrase, category, confidence) in blocks, overlapping ones too; description is the phrase as the dictionary has it.

    ord goes by the place of the first token, then by the number of tokens, so longer phrases of a place come later. Null and empty texts have no
    detections, and neither have empty dictionaries. Very long texts are cut into tokens whole.
    """
    known = index(phrases)
    bounds = known.agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("longest")).first()
    longest = max(bounds.longest or 1, 2)
    heads = known.select(F.slice("parts", 1, 2).alias("h")).distinct().collect() if bounds.n <= BROADCAST else None
    text = marked(F.col("text"))
    rows = blocks.select("doc_id", "block_id", text.alias("_marked"), word_of(text).alias("_low"))
    kinds = {"i": T.IntegerType(), "start": T.IntegerType(), "ends": T.ArrayType(T.IntegerType()), "one": T.StringType(), "two": T.StringType(), "window": T.StringType(), "here": T.StringType()}
    rows = in_arrow(rows, "_marked", [T.StructField(n, t) for n, t in kinds.items()], _windows(longest, None if heads is None else [r.h for r in heads]))
    keys = F.array(F.xxhash64("one"), F.when(F.col("two").isNotNull(), F.xxhash64("one", "two")))
    rows = rows.withColumn("key", F.explode(F.filter(keys, lambda k: k.isNotNull())))
    if bounds.n <= BROADCAST:
        hits = rows.join(F.broadcast(known), "key")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        hits = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "block_id", "i"), F.lit(SALT)).cast("int")).join(salted, ["key", "salt"])
    hits = hits.where(F.startswith("window", F.concat(F.array_join("parts", _END), F.lit(_END))))
    end = F.get("ends", F.col("n") - 1)
    value = F.substring("here", F.lit(1), end - F.col("start"))
    return hits.select("doc_id", "block_id", "category", value.alias("original_value"), "start", end.alias("end"), "confidence", F.lit(method).alias("method"), F.col("phrase").alias("description"), (F.col("i") * longest + F.col("n") - 1).alias("ord"))


def _windows(longest: int, heads: list[list[str]] | None) -> Callable[[pa.RecordBatch, Cut], tuple[np.ndarray, list[pa.Array]]]:
    """Of each token that begins like a phrase (heads: first two tokens of each, or its only one), or of all: place, start, the ends of it and its successors up to

    `longest` tokens, the first two of them as phrases spell them (the second null if there is none), all of them with _END behind each, and what stands in the text
    from the first to the last.
    """
    single = firsts = pairs = None
    if heads is not None:
        single, firsts = (pa.array(sorted({h[0] for h in heads if len(h) in n}), pa.string()) for n in ((1,), (1, 2)))
        pairs = pa.array(sorted({_END.join(h) for h in heads if len(h) == 2}), pa.string())
    is_in = lambda values, known: pc.is_in(values, value_set=known).to_numpy(zero_copy_only=False)

    def columns(batch: pa.RecordBatch, t: Cut) -> tuple[np.ndarray, list[pa.Array]]:
        low = cut(batch.column("_low"))  # marks and gaps are where they are in the text
        n = len(t.row)
        last = np.append(t.first[1:], n)[t.row] if n else t.row  # behind each token's block

        def at(values: pa.Array, place: np.ndarray, j: np.ndarray, end: np.ndarray) -> pa.Array:
            return values.take(pa.array(place[np.minimum(j, n - 1)] if n else j, mask=j >= end))

        def spelt(j: np.ndarray, end: np.ndarray) -> pa.Array:
            return pc.if_else(pc.equal(at(t.parts, t.at - 1, j, end), ""), at(low.parts, low.at, j, end), pc.binary_join_element_wise(" ", at(low.parts, low.at, j, end), ""))

        use = np.arange(n)
        if firsts is not None:
            use = use[is_in(at(low.parts, low.at, use, last), firsts)]
            words = at(low.parts, low.at, use, last[use])
            use = use[is_in(words, single) | is_in(pc.binary_join_element_wise(words, spelt(use + 1, last[use]), _END), pairs)]
        end = last[use]
        words, two = at(low.parts, low.at, use, end), spelt(use + 1, end)
        window, here = pc.binary_join_element_wise(words, _END, ""), at(t.parts, t.at, use, end)
        for k in range(1, longest):
            joined = pc.binary_join_element_wise(spelt(use + k, end), _END, "")
            window = pc.binary_join_element_wise(window, joined, "", null_handling="replace", null_replacement="")
            here = pc.binary_join_element_wise(here, at(t.parts, t.at - 1, use + k, end), at(t.parts, t.at, use + k, end), "", null_handling="replace", null_replacement="")
        count = np.minimum(end - use, longest)
        upto = np.concatenate([[0], np.cumsum(count)])
        ends = t.end[np.repeat(use - upto[:-1], count) + np.arange(upto[-1])]
        lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ends, pa.int32()))
        return t.row[use], [pa.array(t.i[use], pa.int32()), pa.array(t.start[use], pa.int32()), lists, words, two, window, here]

    return columns


def match_longest(blocks: DataFrame, phrases: DataFrame, method: str = "smart_phrase_matcher") -> DataFrame:
    """match() without phrases that overlap one of more words; longer phrases are surer, whatever the dictionary's confidence."""
    words = F.size(F.split(F.trim("phrase"), r"(?U)\s+"))
    surer = F.element_at(F.array(*(F.lit(for_phrase(k)) for k in range(1, 6))), F.least(words, F.lit(5)))
    found = match(blocks, phrases.withColumn("confidence", surer), method)
    size = lambda s: F.size(F.split(s["original_value"], r"(?U)\s+"))
    alone = lambda spans: F.when(F.size(spans) > 1, intervals.longest_first(spans, size)).otherwise(spans)
    return intervals.resolve(intervals.islands(found, "doc_id", "block_id"), alone, "doc_id", "block_id", "island").drop("pos", "island")


def from_words(words: DataFrame, category: str, confidence: float = 0.7) -> DataFrame:
    """phrase, category, confidence of a dictionary's lines (word), as sources.rules.dictionary and government_bodies read them."""
    return words.select(F.col("word").alias("phrase"), F.lit(category).alias("category"), F.lit(float(confidence)).alias("confidence"))


