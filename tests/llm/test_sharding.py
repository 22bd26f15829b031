import hashlib
import random
import zlib

import pytest

from veilspan.llm import sharding


def least_capacity(sizes, shards):
    """By trying every capacity upwards."""
    c = max([-(-sum(sizes) // shards), *sizes])
    while True:
        used, left = 1, c
        for s in sizes:
            if s > left:
                used, left = used + 1, c
            left -= s
        if used <= shards:
            return c
        c += 1


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_plan_equals_plain_version(spark, docs, rows, shards):
    got = sharding.assign_shards(docs, shards).collect()
    groups = {}
    for r in rows:
        text = (r[1] or "").encode()
        key = hashlib.md5(text).hexdigest()
        groups.setdefault(key, []).append(len(text) + 1)
    order = sorted(groups)
    c = least_capacity([sum(groups[k]) for k in order], shards)
    assert {r.capacity for r in got} == {c}
    want, shard, left = {}, 0, c
    for k in order:
        if sum(groups[k]) > left:
            shard, left = shard + 1, c
        left -= sum(groups[k])
        want[k] = shard
    mine = sorted((r.row.doc_id if r.row.doc_id is not None else -1, r.size, r.text_crc32, r.shard) for r in got)
    assert mine == sorted((r[0] if r[0] is not None else -1, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()), want[hashlib.md5((r[1] or "").encode()).hexdigest()]) for r in rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_refinement_finds_the_exact_cuts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST", 1)
    monkeypatch.setattr(sharding, "STEP", 1)
    rng = random.Random(4)
    rows = [(f"{rng.getrandbits(24):06x}", rng.randint(1, 50)) for _ in range(400)] + [("7" * 6, 900)]
    df = spark.createDataFrame(rows, "group_key string, size long")
    sums = {}
    for k, s in rows:
        sums[k] = sums.get(k, 0) + s
    ends, c = sharding.cuts(df, 5)
    assert c == least_capacity([sums[k] for k in sorted(sums)], 5)
    totals = [0] * (len(ends) + 1)
    for k, s in rows:
        totals[sum(k > e for e in ends)] += s
    assert max(totals) <= c and sum(totals) == sum(s for _, s in rows)


def test_more_shards_than_groups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id long, text string")
    got = sharding.assign_shards(df).collect()
    assert len({r.shard for r in got if r.row.doc_id < 3}) == 1 and {r.size for r in got} == {1, 2}
