import hashlib
import random

import numpy as np
import pytest

from veilspan.llm import suffix_dedup as sd


def plain(rows):
    """doc_id, n_bytes, n_removed, n_spans, hash by looking every string up."""
    first = {}
    texts = [(i if i is not None else sd.NO_ID, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for a in range(len(t) - 49):
            s = t[a : a + 50]
            first[s] = min(first.get(s, i), i)
    out = []
    for (i, t), (doc, _) in zip(texts, rows, strict=True):
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - 49):
            if first[t[a : a + 50]] < i:
                gone[a : a + 50] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((doc, len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def made(seed):
    """Texts that share passages of all lengths around 50, of few letters so that chance repeats occur too."""
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "abcdefgh "
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    pool = [word(rng.choice([30, 49, 50, 51, 90, 200])) for _ in range(12)] + ["z" * 120, "é" * 60]
    rows = [(i, "".join(rng.choice(pool) if rng.random() < 0.6 else word(rng.randint(1, 80)) for _ in range(rng.randint(1, 8)))) for i in range(40)]
    return rows + [(40, rows[3][1]), (41, rows[3][1]), (5, rows[7][1]), (None, rows[3][1]), (None, rows[8][1]), (42, None), (43, ""), (44, word(49))]


@pytest.mark.parametrize(("seed", "small"), [(1, False), (2, False), (3, True), (4, True)])
def test_equals_plain_version(spark, monkeypatch, tmp_path, seed, small):
    if small:  # many blocks, and pieces of few texts
        monkeypatch.setattr(sd, "BLOCK_BYTES", 300)
        monkeypatch.setattr(sd, "GRAMS_AT_ONCE", 40)
        monkeypatch.setattr(sd, "SPAN_ROWS", -1)
    rows = made(seed)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, sd.op7_suffix_dedup(spark, str(tmp_path)).collect()), key=repr) == plain(rows)


def test_every_string_holds_an_anchor_at_the_same_place():
    rng = random.Random(5)
    data = np.frombuffer("".join(rng.choice("abc") for _ in range(3000)).encode(), np.uint8)
    offsets = np.array([0, 700, 700, 740, 3000])
    at = set(sd.anchors(data, offsets)[0].tolist())
    places = {}
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        for s in range(a, b - 49):
            inside = [p - s for p in range(s, s + sd.LEFT + 1) if p in at]
            assert inside
            places.setdefault(data[s : s + 50].tobytes(), set()).add(inside[0])


def test_loser_tree_merges_and_knows_prefixes():
    rng = random.Random(7)
    runs, everything = [], []
    for k in range(5):
        words = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(40 * (k != 2)))
        n = len(words)
        right = np.zeros((n, sd.LENGTH), np.uint8)
        for i, w in enumerate(words):
            right[i, : len(w)] = list(w)
        blob = sd._front_coded(np.zeros((n, sd.LEFT), np.uint8), right, np.zeros(n, np.uint8), np.array([len(w) for w in words], np.uint8), np.arange(n, dtype=np.int64), np.zeros(n, np.int32), np.zeros(n, np.int64))
        runs.append(sd.Run(blob))
        everything += words
    got = list(sd.merged(runs))
    assert [item[4] for _, item in got] == sorted(everything)
    for (_, a), (shared, b) in zip(got[:-1], got[1:], strict=True):
        want = next((i for i, (x, y) in enumerate(zip(a[4], b[4], strict=False)) if x != y), min(len(a[4]), len(b[4])))
        assert shared == want


def test_repeated_rows_of_one_id(spark, tmp_path):
    text = "one passage that is long enough to be found again, if only it stood in a text of a smaller id"
    rows = [(7, text)] * 30 + [(3, "x" + text[5:] + "y"), (7, text + "."), (9, text)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, sd.op7_suffix_dedup(spark, str(tmp_path)).collect()), key=repr) == plain(rows)


def test_packed_hashes():
    for values in ([], [5], [1, 2, 1 << 40], list(range(10, 90, 7))):
        a = np.array(values, np.uint64)
        assert sd._unpacked(sd._packed(a)).tolist() == values
