import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from veilspan.llm import resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [f.encode() for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def plain(docs, target):
    """resample() of (doc_id, text) in Python; rows in order."""
    bucket = lambda f: zlib.crc32(f) % 10000
    s, t = (Counter(bucket(f) for text in texts for f in features(text)[1]) for texts in ([d[1] for d in docs], target))
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        words, found = features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1.0) * (S + 10000.0) / ((s[b] + 1.0) * (T + 10000.0)))) for b in map(bucket, found)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["Été", "日本", "B", "x" * 300, "1"]
    text = lambda k: rng.choice((" ", ", ", "\n")).join(rng.choices(words, k=k))
    docs = [(i, text(rng.randint(0, 70))) for i in range(180)] + [(None, text(30)), (500, None), (501, ""), (502, "...")]
    docs += [(i, docs[3][1] + " same tail " * 10) for i in range(600, 640)]
    return docs, [text(40) for _ in range(12)] + [None, ""]


def get(spark, docs, target):
    df = R.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(t,) for t in target], "text string"))
    return sorted(map(tuple, df.collect()), key=repr)


def test_equals_plain_version(spark, tables):
    assert get(spark, *tables) == plain(*tables)


def test_small_tries_and_pieces_change_nothing(spark, tables, monkeypatch):
    monkeypatch.setattr(R, "NODES", 30)
    monkeypatch.setattr(R, "PIECE", 50)
    assert get(spark, *tables) == plain(*tables)


def test_empty_target_or_no_able_document(spark):
    docs = [(1, "a b c " * 9), (2, "a")]
    assert get(spark, docs, []) == plain(docs, [])
    short = [(i, "a b c") for i in range(9)]
    assert get(spark, short, ["a b"]) == plain(short, ["a b"])


def test_equal_scores_go_by_id(spark):
    docs = [(7, "a b " * 20)] * 3 + [(i, "a b " * 20) for i in range(60, 69)]
    got = get(spark, docs, ["a b"])
    assert got == plain(docs, ["a b"]) and sorted(r[4] for r in got if r[4]) == [1, 2, 3]


def test_draw_leans_to_the_target(spark):
    rng = random.Random(1)
    near, far = [f"n{i}" for i in range(40)], [f"f{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(near if i % 4 == 0 else far, k=60))) for i in range(400)]
    got = get(spark, docs, [" ".join(rng.choices(near, k=80)) for _ in range(30)])
    drawn = [r[0] for r in got if r[4]]
    assert len(drawn) == 100 and sum(d % 4 == 0 for d in drawn) > 75


def test_trie_counts_each_path():
    trie = R.Trie()
    rows = [[b"a", b"b", b"a", b"b"], [], [b"b"], [b"c", b"a"]]
    trie.grow(rows[:2])
    trie.grow(rows[2:])
    want = Counter(zlib.crc32(b" ".join(r[i : i + n])) for r in rows for n in (1, 2) for i in range(len(r) - n + 1))
    crc = lambda state: [int(x ^ 0xFFFFFFFF) for x in state]
    assert dict(zip(crc(trie.state) + crc(trie.pair_state), trie.count.tolist() + trie.pair_count.tolist(), strict=True)) == dict(want)
