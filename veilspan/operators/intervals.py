"""Order-sensitive resolution of overlapping detections, as folds over one block's array.

Each function takes an array of structs with at least start, end, confidence, method and ord (the order in which the
detections were produced, which breaks ties), and returns an array of the same structs. gathered() and spread() go from a table of
detections to arrays and back. An array is bounded by one block's text, never by a key that holds many blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.spans import overlap_ratio, overlaps
from ..session import cut
from . import proximity


def gathered(detections: DataFrame, *key: str) -> DataFrame:
    """One row for each key, with an array `spans` of all other columns, by ord."""
    rest = [c for c in detections.columns if c not in key]
    return detections.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ord", *(c for c in rest if c != "ord")))).alias("spans"))


def spread(rows: DataFrame, *key: str) -> DataFrame:
    return rows.select(*key, F.explode("spans").alias("_s")).select(*key, "_s.*")


def resolve(detections: DataFrame, how, *key: str) -> DataFrame:
    """detections with how() applied to each key's array; its order is kept in the column `pos`."""
    rows = gathered(detections, *key).withColumn("spans", how(F.col("spans")))
    return rows.select(*key, F.posexplode("spans").alias("pos", "_s")).select(*key, "pos", "_s.*")


def islands(detections: DataFrame, *key: str) -> DataFrame:
    """detections with `island`: spans of a key that share characters, with each other or through others, have the same one.

    A fold whose spans clash only where they share a character gives the same by islands, and takes time in proportion to the spans if islands are small.
    """
    line = Window.partitionBy(*key).orderBy("start", "end")
    reach = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    rows = detections.withColumn("_begins", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    return rows.withColumn("island", F.sum("_begins").over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("_begins")


def _ordered(spans: Column, *keys) -> Column:
    """spans by the keys (ascending), then by ord."""
    wrapped = F.transform(spans, lambda s: F.struct(*(k(s).alias(f"k{i}") for i, k in enumerate(keys)), s["ord"].alias("o"), s.alias("s")))
    return F.transform(F.array_sort(wrapped), lambda x: x["s"])


def _none(spans: Column) -> Column:
    return F.slice(spans, 1, 0)


def _greedy(spans: Column, clash) -> Column:
    """Each span in turn that clashes with none kept before."""
    return F.aggregate(spans, _none(spans), lambda kept, s: F.when(F.exists(kept, lambda k: clash(s, k)), kept).otherwise(F.concat(kept, F.array(s))))


#: Spans of a block from which greedy() works in rounds, and the rounds before what is left is folded.
LONG, ROUNDS = 2000, 12


def greedy(detections: DataFrame, keys, clash, long: int = LONG, rounds: int = ROUNDS) -> DataFrame:
    """Of each block's detections, by the keys (functions of a span, ascending) and then ord, each that clashes with none kept before; their order is `pos`.

    The same as the fold of resolve(), but blocks of over `long` spans are split over tasks: in each round a span stays that no span before it clashes
    with any more, and those that clash with it go. Clashes are found once, by bins (see proximity), so clash(a, b) must imply a
    shared character. Spans that are undecided after `rounds` rounds (a chain, each clashing with the one before) are folded, without
    those decided. ord tells the detections of a block apart; detections keep all columns. They are computed once and checkpointed, as many steps read them.
    """
    key, detections = proximity.KEY, cut(detections)
    sizes = detections.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > long).select(*key)
    wide = detections.join(sizes, key, "left_semi")
    fold = lambda rows: resolve(rows, lambda spans: _greedy(_ordered(spans, *keys), clash), *key).drop("pos")
    short = fold(detections.join(sizes, key, "left_anti"))
    span = F.struct(*(c for c in detections.columns if c not in key))
    order = F.struct(*(k(span).alias(f"k{i}") for i, k in enumerate(keys)), F.col("ord").alias("o"))
    ranked = wide.withColumn("_o", order)
    before = lambda a, b: (a["_o"] < b["_o"]) & clash(b, a)
    edges = cut(proximity.meeting(ranked, ranked, lambda a, b: before(a, b), ["ord"], ["ord"], ["_o"]))
    left, kept = cut(wide.select(*key, "ord")), wide.select(*key, "ord").limit(0)
    for _ in range(rounds):
        if edges.isEmpty():
            break
        ends = edges.select(*key, F.col("r_ord").alias("ord")).distinct()
        stay = left.join(ends, [*key, "ord"], "left_anti")
        gone = edges.join(stay.withColumnRenamed("ord", "l_ord"), [*key, "l_ord"], "left_semi").select(*key, F.col("r_ord").alias("ord")).distinct()
        kept = cut(kept.unionByName(stay))
        left = cut(left.join(stay, [*key, "ord"], "left_anti").join(gone, [*key, "ord"], "left_anti"))
        for end in ("l_ord", "r_ord"):
            edges = edges.join(left.withColumnRenamed("ord", end), [*key, end], "left_semi")
        edges = cut(edges)
    if edges.isEmpty():
        done = wide.join(kept.unionByName(left), [*key, "ord"], "left_semi")
    else:
        done = wide.join(kept, [*key, "ord"], "left_semi").unionByName(fold(wide.join(left, [*key, "ord"], "left_semi")).select(*wide.columns))
    every = short.select(*detections.columns).unionByName(done.select(*detections.columns)).withColumn("_o", order)
    place = Window.partitionBy(*key).orderBy("_o")
    return every.withColumn("pos", F.row_number().over(place) - 1).select(*key, "pos", *(c for c in detections.columns if c not in key))


def suppressed(detections: DataFrame, threshold: float = 0.8, long: int = LONG, rounds: int = ROUNDS) -> DataFrame:
    """suppress() of each block, long ones in rounds; the threshold is over 0."""
    return greedy(detections, [lambda s: -s["confidence"]], lambda s, k: overlap_ratio(s, k) >= threshold, long, rounds)


def suppress(spans: Column, threshold: float = 0.8) -> Column:
    """By confidence from the highest; a span whose overlap ratio with a kept one reaches the threshold goes."""
    return _greedy(_ordered(spans, lambda s: -s["confidence"]), lambda s, k: overlap_ratio(s, k) >= threshold)


def best_confidence(spans: Column, threshold: float = 0.8, longer: bool = True) -> Column:
    """suppress(), and of equal confidences the longer first."""
    kept = suppress(spans, threshold)
    if not longer:
        return kept
    # the position after suppression breaks ties, as a stable sort does
    wrapped = F.transform(kept, lambda s, i: F.struct((-s["confidence"]).alias("c"), (s["start"] - s["end"]).alias("l"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(wrapped), lambda x: x["s"])


def combine_all(spans: Column, threshold: float = 0.8, combine_overlapping: bool = True) -> Column:
    """suppress() if asked for, then by start."""
    kept = suppress(spans, threshold) if combine_overlapping else spans
    wrapped = F.transform(kept, lambda s, i: F.struct(s["start"].alias("a"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(wrapped), lambda x: x["s"])


def longest_first(spans: Column, words) -> Column:
    """By words(span) and confidence from the highest, then start; a span that overlaps a kept one goes."""
    return _greedy(_ordered(spans, lambda s: -words(s), lambda s: -s["confidence"], lambda s: s["start"]), overlaps)


def left_to_right(spans: Column) -> Column:
    """By start; a span that overlaps a kept one goes."""
    return _greedy(_ordered(spans, lambda s: s["start"]), overlaps)


def first_match(spans: Column, least: float = 0.7) -> Column:
    """The first span, methods in alphabetical order, whose confidence reaches the least; one at most."""
    return F.slice(F.filter(_ordered(spans, lambda s: s["method"]), lambda s: s["confidence"] >= least), 1, 1)


def anchor_groups(spans: Column, joins) -> Column:
    """Arrays of spans: the first unused span is an anchor, and takes all later unused spans that joins(anchor, span).

    Groups aren't transitive: a span is compared with anchors only, and goes to the first anchor that takes it.
    """
    empty = F.slice(F.array(spans), 1, 0)

    def step(groups: Column, s: Column) -> Column:
        at = F.array_position(F.transform(groups, lambda g: joins(F.get(g, F.lit(0)), s)), F.lit(True)).cast("int")
        added = F.transform(groups, lambda g, i: F.when(i == at - 1, F.concat(g, F.array(s))).otherwise(g))
        return F.when(at > 0, added).otherwise(F.concat(groups, F.array(F.array(s))))

    return F.aggregate(spans, empty, step)


def _first_best(group: Column, value) -> Column:
    """The first span of the group with the largest value."""
    most = F.array_max(F.transform(group, value))
    return F.get(F.filter(group, lambda s: value(s) == most), F.lit(0))


def global_dedup(spans: Column, threshold: float = 0.5) -> Column:
    """Of each anchor group (overlap ratio from the threshold) the first span with the highest confidence."""
    groups = anchor_groups(spans, lambda a, s: overlap_ratio(a, s) >= threshold)
    return F.transform(groups, lambda g: _first_best(g, lambda s: s["confidence"]))


def weighted_average(spans: Column, weights: dict[str, float], default: float = 0.5, threshold: float = 0.3) -> Column:
    """Of each anchor group (ratio over the threshold) the span with the heaviest method, with the weighted mean confidence.

    Its method becomes weighted_combination; a group of one stays as it is.
    """

    def weight(s: Column) -> Column:
        out = F.lit(default)
        for method, w in weights.items():
            out = F.when(s["method"] == method, F.lit(w)).otherwise(out)
        return out

    def combined(g: Column) -> Column:
        total = F.aggregate(g, F.lit(0.0), lambda a, s: a + weight(s))
        mean = F.aggregate(g, F.lit(0.0), lambda a, s: a + s["confidence"] * weight(s)) / total
        best = _first_best(g, weight).withField("confidence", mean).withField("method", F.lit("weighted_combination"))
        return F.when((F.size(g) == 1) | (total == 0), F.get(g, F.lit(0))).otherwise(best)

    return F.transform(anchor_groups(spans, lambda a, s: overlap_ratio(a, s) > threshold), combined)


#: Weights of detection methods in the typed engine.
TYPED_WEIGHTS = {"regex": 1.0, "phrase_matcher": 0.9, "spacy_ner": 0.8, "morphological": 0.7, "custom_matcher": 0.6, "context_matcher": 0.5, "keyword": 0.8}


def typed_overlap(spans: Column, weights: dict[str, float] = TYPED_WEIGHTS) -> Column:
    """By start and end; a span that overlaps a kept one replaces the first such if its method, or else its confidence, is higher.

    A span that replaces goes to the end of those kept, so it is compared last.
    """

    def weight(s: Column) -> Column:
        out = F.lit(0.5)
        for method, w in weights.items():
            out = F.when(s["method"] == method, F.lit(w)).otherwise(out)
        return out

    def step(kept: Column, s: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda k: overlaps(s, k)), F.lit(True)).cast("int")
        old = F.get(kept, at - 1)
        better = (weight(s) > weight(old)) | ((weight(s) == weight(old)) & (s["confidence"] > old["confidence"]))
        without = F.filter(kept, lambda k, i: i != at - 1)
        return F.when(at == 0, F.concat(kept, F.array(s))).when(better, F.concat(without, F.array(s))).otherwise(kept)

    return F.aggregate(_ordered(spans, lambda s: s["start"], lambda s: s["end"]), _none(spans), step)
