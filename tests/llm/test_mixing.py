import pytest
from pyspark.sql import functions as F

from veilspan.llm import mixing


def targets(sizes, weights=(5, 2, 1), most=3):
    """By sharing again and again until no source is above its limit."""
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = {}, set(order), float(sum(sizes.values()))
    while True:
        total = sum(w[s] for s in free)
        out |= {s: left * w[s] / total for s in free}
        over = {s for s in free if out[s] > most * sizes[s]}
        if not over:
            return out
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free -= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 50, "c": 10, None: 7}, {"a": 1, "b": 1000, "c": 30}, {"x": 5}, {"a": 0, "b": 9}, {"a": 10, "b": 10, "c": 10, "d": 400, "e": 3}])
def test_targets_equal_plain_version(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = targets(sizes)
    assert got == {s: pytest.approx(t) for s, t in want.items()}
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_meets_targets(spark, docs):
    rows = mixing.mix(docs, ["doc_id", "source"]).collect()
    sizes = {}
    for r in rows:
        sizes[r.row.source] = sizes.get(r.row.source, 0) + r["size"]
    want = targets(sizes)
    for s in sizes:
        mine = [r for r in rows if r.row.source == s]
        assert sum(r.taken for r in mine) == pytest.approx(want[s], abs=1)
        assert all(0 <= r.taken <= 3 * r["size"] and r.source_size == sizes[s] for r in mine)
        assert all(bool(r.slots) == (r.taken > 0) for r in mine)


def test_without_a_slot_nothing_is_taken(spark, docs, monkeypatch):
    whole = mixing.blocks
    monkeypatch.setattr(mixing, "blocks", lambda *a: whole(*a).where("block % 2 = 0"))
    half = mixing.mix(docs, ["source"]).groupBy("row.source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).where("target > 100").collect()
    assert half and all(0.3 * r.target < r.taken < 0.7 * r.target for r in half)


def test_schedule_is_even_at_every_length(spark):
    df = spark.createDataFrame([("a", 500.0), ("b", 300.0), ("c", 200.0)], "source string, target double")
    rows = sorted(mixing.schedule(df).collect())
    assert [r.slot for r in rows] == list(range(mixing.SLOTS))
    seen = {"a": 0, "b": 0, "c": 0}
    for n, r in enumerate(rows, 1):
        assert r.slot_rank == seen[r.source]
        seen[r.source] += 1
        for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
            assert abs(seen[s] - share * n) <= 17


def test_a_tiny_source_gets_a_slot(spark):
    df = spark.createDataFrame([("a", 1e9), ("b", 1.0)], "source string, target double")
    assert {r.source for r in mixing.schedule(df).collect()} == {"a", "b"}
