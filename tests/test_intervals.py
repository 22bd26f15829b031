import random

import plain
import pytest
from pyspark.sql import functions as F

from veilspan.operators import intervals as iv

WEIGHTS = {"spacy_ner": 1.0, "regex": 0.6, "phrase_matcher": 0.7}
CASES = {
    "suppress": (iv.suppress, plain.suppress),
    "best_confidence": (iv.best_confidence, lambda x: sorted(plain.suppress(x), key=lambda s: (-s["confidence"], s["start"] - s["end"]))),
    "combine_all": (iv.combine_all, lambda x: sorted(plain.suppress(x), key=lambda s: s["start"])),
    "longest_first": (lambda c: iv.longest_first(c, lambda s: s["words"]), lambda x: plain.greedy(sorted(x, key=lambda s: (-s["words"], -s["confidence"], s["start"])), plain.strict)),
    "left_to_right": (iv.left_to_right, lambda x: plain.greedy(sorted(x, key=lambda s: s["start"]), plain.strict)),
    "first_match": (iv.first_match, lambda x: [s for s in sorted(x, key=lambda s: s["method"]) if s["confidence"] >= 0.7][:1]),
    "global_dedup": (iv.global_dedup, lambda x: [max(g, key=lambda s: s["confidence"]) for g in plain.groups(x, lambda a, b: plain.ratio(a, b) >= 0.5)]),
    "weighted_average": (lambda c: iv.weighted_average(c, WEIGHTS), lambda x: plain.weighted(x, WEIGHTS)),
    "typed_overlap": (iv.typed_overlap, lambda x: plain.typed(x, iv.TYPED_WEIGHTS)),
}


@pytest.fixture(scope="module")
def spans(spark):
    rng = random.Random(1)
    rows = []
    for g in range(100):
        for o in range(rng.randint(1, 9)):
            a = rng.randint(0, 30)
            rows.append((g, o, a, a + rng.choice([0, 1, 3, 5, 8]), rng.choice([0.5, 0.6, 0.7, 0.8, 0.9]), rng.choice(["regex", "phrase_matcher", "spacy_ner", "x"]), rng.randint(1, 3)))
    return rows, spark.createDataFrame(rows, "g int, ord int, start int, end int, confidence double, method string, words int").cache()


@pytest.mark.parametrize("name", CASES)
def test_fold_equals_loop(spans, name):
    rows, df = spans
    fold, loop = CASES[name]
    got = {}
    for r in iv.resolve(df, fold, "g").collect():
        got.setdefault(r.g, []).append((r.pos, r.ord, r.start, r.end, round(r.confidence, 9), r.method))
    for g in {r[0] for r in rows}:
        mine = [dict(zip(("ord", "start", "end", "confidence", "method", "words"), r[1:], strict=True)) for r in rows if r[0] == g]
        assert [x[1:] for x in sorted(got.get(g, []))] == [(s["ord"], s["start"], s["end"], round(s["confidence"], 9), s["method"]) for s in loop(mine)]


def test_no_rows(spark):
    df = spark.createDataFrame([], "g int, ord int, start int, end int, confidence double, method string")
    assert iv.resolve(df, iv.suppress, "g").count() == 0


def test_ratio_of_empty_span_is_zero(spark):
    from veilspan.functions.spans import overlap_ratio

    a, b = (F.struct(F.lit(s).alias("start"), F.lit(e).alias("end")) for s, e in ((3, 3), (0, 9)))
    assert spark.range(1).select(overlap_ratio(a, b)).first()[0] == 0.0
