"""The store of detections: expiry, last use, eviction, staged commits."""

import os

from pyspark.sql import functions as F

from veilspan.operators import caching, extract
from veilspan.sources.rules import ASCII_RULES


def blocks(spark, *texts):
    return spark.createDataFrame([(i, "b", t) for i, t in enumerate(texts)], "doc_id int, block_id string, text string")


def searched(spark, path, seen, now, *texts, expiry=100):
    """The texts that a run had to search, by an accumulator of theirs."""
    acc = spark.sparkContext.accumulator(0)

    def detect(b):
        one = b.cache()
        acc.add(one.count())
        return extract.scan(one, ASCII_RULES)

    got = caching.with_store(blocks(spark, *texts), detect, path, expiry, now)
    assert sorted((r.doc_id, r.original_value) for r in got.collect()) == sorted((i, w.strip(".,")) for i, t in enumerate(texts) if t for w in t.split() if "@" in w)
    return acc.value


def test_only_what_has_no_young_entry_is_searched(spark, tmp_path):
    path = str(tmp_path / "store")
    run = lambda now, *texts: searched(spark, path, None, now, *texts)
    assert run(1000, "a@b.com", "A@b.com", "a@b.com", "none", "", None) == 3
    assert run(1050, "a@b.com", "c@d.org") == 1
    assert run(1099, "a@b.com", "A@b.com", "none") == 0
    assert run(1101, "a@b.com", "c@d.org") == 1  # the first entry is 101 seconds old, the second 51
    assert run(1300, "a@b.com") == 1


def test_eviction_keeps_what_was_used_last(spark, tmp_path):
    path = str(tmp_path / "store")
    run = lambda now, *texts: searched(spark, path, None, now, *texts)
    run(1000, *(f"a{i}@b.com" for i in range(6)))
    run(1010, "a0@b.com", "a1@b.com", "new@b.com")
    assert caching.evicted(spark, path, 100, 10, 1020) == (7, 0)
    assert caching.evicted(spark, path, 100, 4, 1020) == (4, 3)  # those used at 1010, and of the others the least key
    assert run(1030, "a0@b.com", "a1@b.com", "new@b.com") == 0
    kept = min((f"a{i}@b.com" for i in range(2, 6)), key=lambda t: spark.range(1).select(F.sha2(F.lit(t), 256)).first()[0])
    assert run(1031, kept) == 0 and run(1032, next(f"a{i}@b.com" for i in range(2, 6) if f"a{i}@b.com" != kept)) == 1
    assert caching.evicted(spark, path, 20, 10, 1040) == (1, 4)  # all but the last entry expired
    assert caching.evicted(spark, path, 1, 10, 9999) == (0, 1)
    assert run(10_000, "a0@b.com") == 1


def test_uncommitted_rows_and_missing_stores_are_no_error(spark, tmp_path):
    path = str(tmp_path / "store")
    assert caching.evicted(spark, path) == (0, 0)
    searched(spark, path, None, 10, "a@b.com")
    os.makedirs(f"{path}/staged/half")
    (tmp_path / "store" / "staged" / "half" / "part.parquet").write_bytes(b"half")
    assert searched(spark, path, None, 11, "a@b.com", "x@y.com") == 1
