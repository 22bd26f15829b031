"""Intervals by bins, cues near entities, greedy resolution in rounds, substrings by runs of characters: against loops over all pairs."""

import random

import plain
import pytest
from pyspark.sql import functions as F

from veilspan.functions.spans import overlap_ratio, overlaps
from veilspan.operators import combine, extract, intervals, proximity

SPANS = "doc_id long, block_id string, ord int, start int, end int, confidence double, category string, original_value string"


def rows_of(rng, n, length=2000, widths=(0, 1, 3, 5, 30, 256, 700)):
    out = []
    for o in range(n):
        a = rng.choice((rng.randrange(length), 256 * rng.randrange(length // 256)))
        out.append((rng.randrange(4), rng.choice("ab"), o, a, a + rng.choice(widths), rng.choice((0.5, 0.6, 0.7, 0.9)), rng.choice(("x", "y")), f"v{o}"))
    return out


def same_block(a, b):
    return a[:2] == b[:2]


def as_dict(r):
    return {"start": r[3], "end": r[4], "confidence": r[5]}


@pytest.mark.parametrize("threshold", [None, 0.3, 0.8])
def test_anti_join_equals_all_pairs(spark, threshold):
    rng = random.Random(1)
    left, right = rows_of(rng, 200), rows_of(rng, 60)
    left += left[:5]  # repeated rows
    hit = lambda a, b: plain.strict(as_dict(a), as_dict(b)) if threshold is None else plain.ratio(as_dict(a), as_dict(b)) >= threshold
    got = extract.not_overlapping(spark.createDataFrame(left, SPANS), spark.createDataFrame(right, SPANS), threshold)
    want = [a for a in left if not any(same_block(a, b) and hit(a, b) for b in right)]
    assert sorted(map(tuple, got.select(*spark.createDataFrame(left, SPANS).columns).collect())) == sorted(want) and 0 < len(want) < len(left)


def test_pairs_that_share_a_bin_come_once(spark):
    rng = random.Random(2)
    left, right = rows_of(rng, 80), rows_of(rng, 80)
    got = proximity.meeting(spark.createDataFrame(left, SPANS), spark.createDataFrame(right, SPANS), overlaps, ["ord"], ["ord"]).collect()
    want = {(a[0], a[1], a[2], b[2]) for a in left for b in right if same_block(a, b) and plain.strict(as_dict(a), as_dict(b))}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("width", [0, 40, 300])
def test_nearest_cue_equals_all_pairs(spark, width):
    rng = random.Random(3)
    entities, cues = rows_of(rng, 150), [(*r[:7], f"c{r[2]}") for r in rows_of(rng, 90, widths=(1, 4, 9))]
    got = {(r.doc_id, r.block_id, r.ord): (r.distance, r.cue_start) for r in proximity.with_cues(spark.createDataFrame(entities, SPANS), spark.createDataFrame(cues, SPANS), width).collect()}
    want = {}
    for e in entities:
        near = []
        for c in cues:
            if same_block(e, c) and e[6] == c[6]:
                near.append((max(0, e[3] - c[4], c[3] - e[4]), c[3]))
        if near and min(near)[0] <= width:
            want[e[0], e[1], e[2]] = min(near)[0]
    assert {k: d for k, (d, _) in got.items()} == want and len(want) > 10
    starts = {(c[0], c[1], c[3]) for c in cues}
    assert all((d, b, s) in starts for (d, b, _), (_, s) in got.items())


@pytest.mark.parametrize("long, rounds", [(0, 12), (0, 1), (0, 0), (20, 12), (10**6, 12)])
def test_rounds_equal_the_fold(spark, long, rounds):
    rng = random.Random(4)
    rows = rows_of(rng, 160, widths=(1, 5, 30, 90))
    rows += [(9, "chain", i, 3 * i, 3 * i + 4, 0.5, "x", f"v{i}") for i in range(40)]  # each clashes with the one before
    df = spark.createDataFrame(rows, SPANS)
    for keys, clash, fold in [
        ([lambda s: -s["confidence"]], lambda s, k: overlap_ratio(s, k) >= 0.5, lambda c: intervals.suppress(c, 0.5)),
        ([lambda s: s["start"]], overlaps, intervals.left_to_right),
    ]:
        got = intervals.greedy(df, keys, clash, long, rounds)
        want = intervals.resolve(df, fold, "doc_id", "block_id").select(*got.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rounds_of_nothing(spark):
    assert intervals.suppressed(spark.createDataFrame([], SPANS), long=0).count() == 0


def test_metadata_matches_equal_all_pairs(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abé ", k=n))
    values = [(d, "core", f"p{i}", word(rng.randint(0, 30))) for d in range(4) for i in range(25)]
    originals = [(d, o, word(rng.randint(1, 6)) if o % 5 else values[25 * d + o % 25][3], f"u{o}", f"c{o % 3}") for d in range(4) for o in range(40)]
    got = combine.metadata_matches(spark.createDataFrame(values, "doc_id long, section string, property string, value string"), spark.createDataFrame(originals, "doc_id long, ord int, original_value string, uuid string, category string")).collect()
    want = set()
    for d, section, prop, value in values:
        mine = [r for r in originals if r[0] == d]
        equal = [r for r in mine if r[2] == value]
        part = [r for r in mine if len(r[2]) >= 3 and r[2] in value]
        if equal:
            want.add((d, section, prop, value, equal[-1][3], 1.0, None))
        elif part:
            want.add((d, section, prop, value, part[0][3], 0.8, tuple(sorted({r[2] for r in part}))))
    assert {(r.doc_id, r.section, r.property, r.value, r.uuid, r.confidence, tuple(r.partial_matches) if r.partial_matches else None) for r in got} == want
    assert {c for *_, c, _ in want} == {1.0, 0.8}


def test_long_blocks_are_split(spark):
    """A block of 20,000 spans: each meets its neighbours only."""
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("b").alias("block_id"), F.col("id").cast("int").alias("ord"), (F.col("id") * 7).cast("int").alias("start"), (F.col("id") * 7 + 9).cast("int").alias("end"), ((F.col("id") * 7919 % 1000) / 1000).alias("confidence"))
    kept = intervals.greedy(rows, [lambda s: -s["confidence"]], overlaps, long=100)
    spans = sorted((r.start, r.end) for r in kept.collect())
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and 6000 < len(spans) < 10_001


def counted(spark, df):
    """df, and a count of its rows that are read."""
    seen = spark.sparkContext.accumulator(0)

    def rows(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(rows, df.schema), seen


DETECTIONS = "doc_id long, block_id string, category string, start int, end int, original_value string, confidence double, method string, ord int"


def test_rounds_read_the_detections_once(spark):
    made = [(i % 3, "b", "c", i, i + 4, "v", 0.5, "m", i) for i in range(30)]
    spans, seen = counted(spark, spark.createDataFrame(made, DETECTIONS))
    assert intervals.suppressed(spans, 0.2, long=0).count() > 0
    assert seen.value == 30


def test_entities_are_read_once(spark):
    made = [(i % 3, "b", "c", 100 * i, 100 * i + 4, "v", 0.5, "m", i) for i in range(30)]
    cues = spark.createDataFrame([(i % 3, "b", "c", 100 * i + 6, 100 * i + 9, "cue", 0.5, "m", i) for i in range(0, 30, 2)], DETECTIONS)
    spans, seen = counted(spark, spark.createDataFrame(made, DETECTIONS))
    assert sorted(r.ord for r in proximity.with_cues(spans, cues, 5).collect()) == list(range(0, 30, 2))
    assert seen.value == 30
