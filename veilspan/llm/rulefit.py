"""Quality classifier: a sparse ensemble of rules over text statistics.

Small gradient-boosted trees are grown over quantile bins of the statistics; every path from a root to a node is a
conjunctive rule; a lasso-penalised logistic regression over the rules keeps few of them; and these are compiled into one
Spark column expression. The fit runs in numpy on the driver, on at most SAMPLE labelled rows, which are those with the
smallest hashes of their id; the score is computed for every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boosting
from . import textbytes as tb

#: The most labelled rows that are learnt from.
SAMPLE = 20_000
TREES, DEPTH = 16, 3
PENALTY, STEPS = 2e-4, 600
ACCEPT = 0.7

#: Ratios of statistics, as (name, numerator, denominator); the denominator counts as 1 at least.
RATIOS = (
    ("symbols_per_char", "n_symbols", "n_chars"),
    ("upper_per_char", "n_upper", "n_chars"),
    ("digits_per_char", "n_digits", "n_chars"),
    ("marks_per_word", "n_marks", "n_words"),
    ("marked_words", "n_marked_words", "n_words"),
    ("distinct_words", "n_distinct_words", "n_words"),
    ("repeat_words", "n_repeat_words", "n_words"),
    ("dup_lines", "n_dup_lines", "n_lines"),
    ("short_words", "n_short_words", "n_words"),
    ("word_length", "word_chars", "n_words"),
    ("line_length", "n_words", "n_lines"),
    ("wide_per_char", "n_wide", "n_chars"),
)
FEATURES = ("n_words", "n_lines", *(r[0] for r in RATIOS))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, whether above, bound), and its weight."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[Rule, ...]

    def column(self) -> Column:
        """The score over the columns that with_features() adds."""
        total = F.lit(float(self.intercept))
        for r in self.rules:
            holds = F.lit(True)
            for f, above, bound in r.terms:
                c = F.col(f"_f_{FEATURES[f]}")
                holds &= (c > F.lit(float(bound))) if above else (c <= F.lit(float(bound)))
            total += F.when(holds, F.lit(float(r.weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(values: np.ndarray, labels: np.ndarray) -> Model:
    """The ensemble for values (rows by FEATURES) and 0/1 labels; without both labels, their smoothed share alone."""
    grown = boosting.fit(values, labels, TREES, DEPTH)
    paths = grown.paths()
    if not paths:
        return Model(grown.prior, ())
    held = np.stack([boosting.held(values, terms) for terms in paths], 1).astype(np.float64)
    weights, intercept = _lasso(held, labels.astype(float), grown.prior)
    return Model(intercept, tuple(Rule(t, float(w)) for t, w in zip(paths, weights, strict=True) if w))


def _lasso(x: np.ndarray, y: np.ndarray, intercept: float) -> tuple[np.ndarray, float]:
    """Logistic weights under an L1 penalty, by accelerated proximal gradient steps; the intercept isn't penalised."""
    n, k = x.shape
    step = 4 * n / max(np.linalg.norm(x.T @ x, 2) + n, 1e-9)
    w = z = np.zeros(k)
    b = c = intercept
    t = 1.0
    for _ in range(STEPS):
        r = 1 / (1 + np.exp(-(x @ z + c))) - y
        moved = z - step * (x.T @ r) / n
        new, nb = np.sign(moved) * np.maximum(np.abs(moved) - step * PENALTY, 0), c - step * r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, c = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return np.where(np.abs(w) < 1e-4, 0, w), float(b)


def with_features(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns of carry, and _f_ with each of FEATURES, of each row of docs."""
    names = [f"_s_{c}" for c in tb.STATISTICS]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [tb.statistics(data, offsets) for _, _, data, offsets in tb.chunks(batch.column("text"))]
            if parts:
                arrays = [pa.array(np.concatenate([p[c] for p in parts])) for c in tb.STATISTICS]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *arrays], [*carry, *names])

    fields = [T.StructField(c, docs.schema[c].dataType) for c in carry] + [T.StructField(c, T.LongType()) for c in names]
    stats = docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(rows, T.StructType(fields))
    ratios = {name: F.col(f"_s_{a}") / F.greatest(F.col(f"_s_{b}"), F.lit(1)) for name, a, b in RATIOS}
    ratios |= {name: F.col(f"_s_{name}").cast("double") for name in ("n_words", "n_lines")}
    return stats.select(*carry, *(ratios[k].alias(f"_f_{k}") for k in FEATURES))


def _crc_rest(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of labels.quality; ids whose CRC-32 leaves 2 modulo 4 are held out, and so are ids with differing labels."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (_crc_rest(F.col("doc_id")) != 2))
    ids = ids.groupBy("doc_id").agg(F.min("quality").alias("_y"), F.max("quality").alias("_z")).where("_y = _z").select("doc_id", "_y")
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    got = with_features(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), ["doc_id", "_y"])
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", *(f"_f_{f}" for f in FEATURES)).limit(SAMPLE).collect()
    values = np.array([[r[f"_f_{f}"] for f in FEATURES] for r in got], float).reshape(len(got), len(FEATURES))
    return fit(values, np.array([r["_y"] for r in got], int))


def classify(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """The columns of carry (not named score or predicted), score (0 to 1) and predicted (1 if score >= ACCEPT) of each row of docs."""
    scored = with_features(docs, carry).withColumn("score", model.column())
    return scored.select(*carry, "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are predicted 1, in docs' columns, whatever their names."""
    names = [c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    kept = classify(docs.toDF(*names), model, names).where("predicted = 1").select(*names)
    return kept.toDF(*docs.columns)


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model learnt from the labels that aren't held out.

    A null or empty text has statistics 0 and the score that follows from them. Repeated rows get equal scores; labels of
    null or unknown ids are not used; without labels of both kinds the score is their smoothed share. An empty table gives
    no rows. Columns other than doc_id and text are not read.
    """
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = classify(docs, train(docs, labels), ["doc_id"])
    held = F.coalesce(_crc_rest(F.col("doc_id")) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
