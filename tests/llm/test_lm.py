import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from veilspan.llm import pseudolikelihood as pl
from veilspan.llm import textbytes as tb


def test_scores_equal_plain_version(spark, docs, rows, monkeypatch):
    model = pl.fit(docs)
    got = sorted((r.doc_id or -1, r.n_tokens, r.log_likelihood) for r in pl.score(docs, model).collect())
    places, windows, both = [], Counter(), Counter()
    for r in rows:
        texts = re.findall("[^ \\t-\\r]+", r[1] or "")
        w = tb.Words(np.frombuffer((r[1] or "").encode(), np.uint8), np.array([0, len((r[1] or "").encode())]))
        at = pl._vocabulary(w)[0].tolist()
        c = [0, 0, *model.classes[at].tolist(), 0, 0]
        t = ["", "", *texts, "", ""]
        coarse = lambda k: 0 if k == 0 else 1 if k <= pl.SINGLES else 2 + (k - 1 - pl.SINGLES) // 4 % 2
        mine = []
        for i in range(len(texts)):
            context = ((coarse(c[i]) * pl.CLASSES + c[i + 1]) * pl.CLASSES + c[i + 3]) * pl.COARSE + coarse(c[i + 4])
            prior = float(model.cells[context * pl.CLASSES + c[i + 2]]) + float(model.shares[at[i]])
            window = (t[i + 1], t[i + 3]) if max(c[i + 1], c[i + 3]) > pl.SINGLES else (t[i], t[i + 1], t[i + 3], t[i + 4])
            windows[window] += 1
            both[window, at[i]] += 1
            mine.append((prior, window, at[i]))
        places.append((r[0] or -1, mine))
    want = []
    for i, mine in places:
        total = 0.0
        for prior, window, word in mine:
            n, k = windows[window] - 1, both[window, word] - 1
            total += math.log((k + pl.WEIGHT * math.exp(prior)) / (n + pl.WEIGHT)) if n else prior
        want.append((i, len(mine), total))
    want.sort()
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(abs(x[2] - y[2]) < 0.01 + 0.005 * y[1] for x, y in zip(got, want, strict=True))
    for small in ("BLOCK", "BATCH"):  # blocks and batches don't matter
        monkeypatch.setattr(pl, small, 500)
    again = sorted((r.doc_id or -1, r.n_tokens, r.log_likelihood) for r in pl.score(docs, model).collect())
    assert [x[:2] for x in again] == [x[:2] for x in got] and np.allclose([x[2] for x in again], [x[2] for x in got], atol=1e-6)


def test_chances_of_all_words_add_up(spark, docs):
    model = pl.fit(docs)
    words = np.exp(model.shares.astype(float))
    assert np.allclose(np.bincount(model.classes, words, pl.CLASSES)[1:], 1, atol=1e-3)
    rng = np.random.default_rng(1)
    cells = model.cells.reshape(pl.CONTEXTS, pl.CLASSES)
    for context in rng.integers(0, pl.CONTEXTS, 5):
        prior = np.exp(cells[context][model.classes].astype(float)) * words
        assert prior.sum() == pytest.approx(1, abs=1e-3)
        others = Counter(rng.integers(0, pl.VOCABULARY, 7).tolist())
        chances = [(others[v] + pl.WEIGHT * prior[v]) / (7 + pl.WEIGHT) for v in others]
        rest = pl.WEIGHT * (prior.sum() - sum(prior[v] for v in others)) / (7 + pl.WEIGHT)
        assert sum(chances) + rest == pytest.approx(1, abs=1e-3)


def test_a_text_that_occurs_twice_stands_out(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(60)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts + texts[:5])), "doc_id long, text string")
    got = {r.doc_id: r.mean_log_likelihood for r in pl.score(df, pl.fit(df)).collect()}
    assert min(got[i] for i in (*range(5), *range(60, 65))) > max(got[i] for i in range(5, 60)) + 1


def test_chances_add_up():
    rng = np.random.default_rng(0)
    counts = np.zeros((pl.CONTEXTS, pl.CLASSES), np.int64)
    counts[rng.integers(0, pl.CONTEXTS, 500), rng.integers(0, pl.CLASSES, 500)] = 3
    out = pl.train(counts, steps=5)
    assert np.allclose(np.exp(out[::997]).sum(1), 1, atol=1e-4)
    assert np.allclose(pl.train(np.zeros_like(counts))[:, 1:], -np.log(pl.CLASSES - 1))


def test_training_learns_both_sides():
    """A class that the right neighbour decides, and one that the left one does."""
    counts = np.zeros((pl.CONTEXTS, pl.CLASSES), np.int64)
    parts = np.stack(pl._context_parts(), 1)
    for k, (_, a, b, _) in enumerate(parts):
        if a in (1, 2) and b in (3, 4):
            counts[k, 10 + a * 2 + b] = 50
    out = pl.train(counts)
    k = int(np.flatnonzero((parts == [1, 1, 3, 1]).all(1))[0])
    assert int(out[k].argmax()) == 15 and float(np.exp(out[k, 15])) > 0.8


def test_text_in_order_scores_better_than_shuffled(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    model = pl.fit(docs)
    rng = random.Random(1)
    texts = [(r.doc_id, r.text.split()) for r in docs.collect() if len(r.text.split()) >= 50]
    whole = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")
    mixed = spark.createDataFrame([(i, " ".join(rng.sample(w, len(w)))) for i, w in texts], "doc_id long, text string")
    a, b = ({r.doc_id: r.log_likelihood for r in pl.score(d, model).collect()} for d in (whole, mixed))
    assert np.mean([a[i] > b[i] for i in a]) > 0.9


def test_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "one")], "doc_id long, text string")
    got = {r.doc_id: r for r in pl.score(df, pl.fit(df)).collect()}
    assert got[1].n_tokens == 0 and got[2].perplexity == 1.0 and got[3].n_tokens == 1 and got[3].log_likelihood <= 0


@pytest.mark.parametrize("size", [64, 640])
def test_sums_over_tasks(spark, size):
    df = spark.createDataFrame([(i, "a b c") for i in range(10)], "doc_id long, text string").repartition(4)
    got = pl._counted(df, lambda data, offsets: np.arange(len(data)) % size, size)
    assert got.sum() == 50
