import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilspan.llm import boosting, quality_rules, rulefit
from veilspan.llm import textbytes as tb


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside), "n_distinct_words": len(set(words)), "n_chars": len(text)}


@pytest.mark.parametrize("chunk", [300, 1 << 17])
def test_statistics_equal_plain_counts(monkeypatch, rows, chunk):
    monkeypatch.setattr(tb, "CHUNK", chunk)
    rng = random.Random(2)
    texts = [r[1] for r in rows] + ["".join(rng.choice("ab \n\té#") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    for first, last, data, offsets in tb.chunks(pa.array(texts)):
        got = tb.statistics(data, offsets)
        for i in range(first, last):
            for name, want in base(texts[i]).items():
                assert got[name][i - first] == want, (name, texts[i][:60])


def test_verdict_equals_plain_version(spark, folder, rows):
    tables = [spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels")]
    got = {(r.doc_id, r.n_words): r for r in quality_rules.judge(*tables).collect()}
    trusted = {i for i in range(0, 60, 2)}
    counts = np.zeros((2, quality_rules.BUCKETS))
    grams = {}
    for k, r in enumerate(rows):
        raw = (r[1] or "").encode()
        grams[k] = [int.from_bytes(raw[i : i + 4], "little") * 0x9E3779B1 % (1 << 32) >> 16 for i in range(len(raw) - 3)]
        for g in grams[k]:
            counts[0, g] += 1
            counts[1, g] += r[0] in trusted
    share = (counts + 1) / (counts + 1).sum(1, keepdims=True)
    ratio = np.log(share[1] / share[0])
    for k, r in enumerate(rows):
        b = base(r[1])
        mine = got[r[0], b["n_words"]]
        score = float(np.mean(ratio[grams[k]])) if grams[k] else 0.0
        assert mine.llr == pytest.approx(score, abs=1e-9)
        failed = b["n_words"] < 20 or 100 * b["n_repeat_words"] > 30 * b["n_words"]
        assert mine.base_failed == failed and mine.kept == (not failed and score >= quality_rules.THRESHOLD)


def test_without_trusted_documents_the_base_decides(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_rules.judge(docs, none)
    assert got.where("llr <> 0 or kept <> (not base_failed)").count() == 0


def test_compiled_rules_equal_the_model(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, len(rulefit.FEATURES)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7) | (x[:, 5] > 0.9)).astype(int)
    model = rulefit.fit(x, y)
    assert 0 < len(model.rules) <= 16 * 14
    total = np.full(400, model.intercept)
    for r in model.rules:
        total += r.weight * boosting.held(x, r.terms)
    want = 1 / (1 + np.exp(-total))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], ["i", *(f"_f_{f}" for f in rulefit.FEATURES)])
    got = [r.s for r in df.select("i", model.column().alias("s")).orderBy("i").collect()]
    assert np.allclose(got, want) and ((np.array(got) > 0.5) == y).mean() > 0.95


def test_labels_of_one_kind_give_their_share():
    assert rulefit.fit(np.zeros((50, len(rulefit.FEATURES))), np.ones(50, int)).rules == ()


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    got = rulefit.op2_quality_classifier(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right >= 0.97


def test_held_out_labels_are_not_learnt(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rulefit.train(docs, labels) == rulefit.train(docs, turned)


def test_clashing_columns(spark, docs):
    odd = docs.withColumns({"score": F.lit("x"), "n_words": F.lit(1), "_f_n_words": F.lit(2.0)}).drop("_f_n_words")
    model = rulefit.Model(0.0, ())
    assert rulefit.classify(odd, model, ["doc_id", "n_words"]).columns == ["doc_id", "n_words", "score", "predicted"]


def test_every_trusted_document_counts(spark, monkeypatch):
    n = 20_050
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality")
    assert quality_rules.trusted_ids(labels).count() == n
    docs = spark.range(2 * n).selectExpr("id AS doc_id", "concat('text number ', id) AS text")
    want = np.zeros((2, quality_rules.BUCKETS))
    for i in range(2 * n):
        b = quality_rules.gram_buckets(np.frombuffer(f"text number {i}".encode(), np.uint8))
        for row in range(1 + (i < n)):
            np.add.at(want[row], b, 1)
    shares = (want + quality_rules.SMOOTHING) / (want + quality_rules.SMOOTHING).sum(1, keepdims=True)
    for bound in (n, 0):  # broadcast, shuffled
        monkeypatch.setattr(quality_rules, "BROADCAST_IDS", bound)
        assert np.allclose(quality_rules.log_ratios(docs, quality_rules.trusted_ids(labels)), np.log(shares[1] / shares[0]))
