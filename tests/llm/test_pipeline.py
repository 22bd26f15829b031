import hashlib
import math
import re
from collections import Counter
from itertools import groupby

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

from veilspan.llm import decontam, mixing, rulefit


def test_stages_chain(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, out = docs.columns, {}
    for name, stage in cp.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = (before, docs)
        if name != "sharding":
            assert docs.columns == columns
    before, after = out["quality_classifier"]
    model = rulefit.train(before, spark.read.parquet(f"{folder}/labels.parquet"))
    want = rulefit.classify(before, model, ["doc_id", "text"]).where("predicted = 1")
    assert sorted(map(repr, after.select("doc_id", "text").collect())) == sorted(map(repr, want.select("doc_id", "text").collect()))
    before, after = out["benchmark_decontamination"]
    hits = decontam.contamination(before, spark.read.parquet(f"{folder}/benchmark.parquet"), ["doc_id"]).where("n_hit > 0")
    assert hits.count() > 0 and after.count() == before.count() - hits.count()
    before, after = out["mixing"]
    words = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    assert abs(words(after) - words(before)) <= 0.5 * max(len((r.text or "").split()) for r in before.collect()) * 4
    assert max(r["count"] for r in after.groupBy("doc_id", "text").count().collect()) <= mixing.MOST_TIMES
    before, after = out["sharding"]
    assert after.count() == before.count() and after.columns == [*columns, "size", "text_crc32", "shard", "slot"]


CLASHES = "score predicted c0 _c0 row _row key _key _order order range place size _size shard slot text_crc32 group_key n_hit items t _t fp shingles _id _hash block taken target source_size _f_n_words _s_n_words capacity".split()


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_columns_may_have_any_names(spark, folder, name, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASHES})
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    want, got = stage(spark, docs, folder), stage(spark, odd, folder)
    assert got.columns == (odd.columns if name != "sharding" else [c for c in odd.columns if c not in ("size", "text_crc32", "shard", "slot")] + ["size", "text_crc32", "shard", "slot"])
    kept = [c for c in CLASHES if name != "sharding" or c not in ("size", "text_crc32", "shard", "slot")]
    rows = got.collect()
    assert all(r[c] == f"{c}:{'-' if r.doc_id is None else r.doc_id}" for r in rows for c in kept)
    assert sorted(repr([r[c] for c in columns]) for r in rows) == sorted(repr([r[c] for c in columns]) for r in want.collect())


def plain_words(text):
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


def test_mixing_follows_the_schedule(spark, folder):
    """A plain walk over the schedule: each slot's block of its source's line, and copies in the order of the slots they begin in."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(plain_words(r.text))
    sizes = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    plan = sorted(mixing.blocks(mixing.source_targets(sizes)).collect(), key=lambda r: r.slot)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    lines = {}
    for i, r in enumerate(rows):
        key = "~" if r.source is None else f"={r.source}"
        lines.setdefault(key, []).append((md5(f"{'' if r.doc_id is None else r.doc_id}:{md5(r.text or '')}"), len(plain_words(r.text)), i))
    taken, begun, out = Counter(), Counter(), []
    for key, line in lines.items():
        line = sorted(line)
        tokens = [(i, k) for _, n, i in line for k in range(n)]
        for b in (b for b in plan if b.key == key):
            for at in range(b.begin, b.end):
                i, k = tokens[at % len(tokens)]
                taken[i] += 1
                if k == 0:
                    begun[i] += 1
                    out.append((b.slot, i, begun[i]))
    times = {i: math.floor(taken[i] / len(plain_words(rows[i].text)) + 0.5) for i in taken}
    want = [(slot, repr(rows[i])) for slot, i, turn in sorted(out) if turn <= times[i]]
    mixed = [repr(r) for r in cp.mix_sources(spark, docs, folder).collect()]
    assert len(mixed) == len(want)
    for _, group in groupby(want, lambda x: x[0]):  # documents may begin in one slot
        here = [r for _, r in group]
        assert sorted(mixed[: len(here)]) == sorted(here)
        mixed = mixed[len(here) :]
    assert {(r.row.doc_id, r.taken) for r in mixing.mix(docs, ["doc_id"]).collect()} == {(rows[i].doc_id, taken[i]) for i in range(len(rows))}


def test_decontamination_equals_plain_version(spark, folder):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = split(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = lambda w: not any(tuple(w[i : i + n]) in windows for n in range(1, 11) for i in range(len(w) - n + 1))
    want = [r for r in docs.collect() if clean(split(r.text))]
    assert 0 < len(want) < docs.count()
    assert sorted(map(repr, cp.drop_contaminated(spark, docs, folder).collect())) == sorted(map(repr, want))


def test_near_copies_equal_plain_version(spark, folder):
    """Of each component of texts with a similarity of 0.8 (by all pairs) the row with the smallest id stays, ids that are null last."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.collect()

    def shingles(t):
        w = plain_words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, parent = [shingles(r.text) for r in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (not a and not b) or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                parent[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        k = find(i)
        key = (r.doc_id is None, r.doc_id or 0)
        best[k] = min(best.get(k, key), key)
    got = cp.drop_near_copies(spark, docs, folder).collect()
    of = {repr(r): find(i) for i, r in enumerate(rows)}
    assert sorted(of[repr(r)] for r in got) == sorted(best)
    assert all((r.doc_id is None, r.doc_id or 0) == best[of[repr(r)]] for r in got)


def test_run(spark, folder, nothing):
    assert cp.run(spark, folder).count() > 0
    assert cp.run(spark, nothing).count() == 0


def test_entry_has_the_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
