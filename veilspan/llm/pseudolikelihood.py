"""Language-model scores: masked pseudo-likelihood under a bidirectional window network, with the corpus's own windows as evidence.

The vocabulary is VOCABULARY hashed words, bound to the words' shapes (length, case, marks, letters beyond ASCII). Every word has a class: the
SINGLES most frequent words have one each, all others one by their shape. A network reads the classes of the words on both sides (the
next at each side in full, the second next by a coarse class), and gives the chances of the masked word's class; a word's chance within its
class is its share in the corpus. So the network gives a chance to every word of the vocabulary in every window, and these add up to 1.

That is the prior; what the corpus itself holds in the same window is the evidence. Of the n other places of the corpus with the same
words on both sides (two on each side where the nearest are both among the SINGLES), k hold the masked word, and its chance is
(k + WEIGHT * prior) / (n + WEIGHT), which adds up to 1 too. A document's score is the sum of the log chances of all its words, each masked in turn;
the place itself is never evidence, so a text that stands nowhere else is scored by the network alone.

All of the corpus is learnt from. Two passes count words and classes in their contexts; these counts are sufficient for training, whatever the
corpus's size, and the network is fitted in numpy on the driver by full-batch steps. The evidence grows with the corpus, and never leaves the
executors: the last pass deals all places out by window into blocks of BLOCK words or so, where equal windows meet, and what a block finds goes
back to the batch of documents that asked. One window's places meet in one task, 11 bytes each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb

#: Classes: 0 stands beyond either end of a text, then single words, then shapes.
CLASSES, SINGLES, COARSE = 64, 31, 4
SHAPES = CLASSES - 1 - SINGLES
#: Hashed words of each shape.
SHAPE_BITS = 15
VOCABULARY = SHAPES << SHAPE_BITS
CONTEXTS = COARSE * CLASSES * CLASSES * COARSE
HIDDEN, STEPS, RATE, SEED = 24, 120, 0.05, 11
SMOOTHING = 0.5
#: The log chance of what can't be.
NEVER = -1e9
#: What the prior weighs against places of the corpus.
WEIGHT = 4.0
#: Words of a block of windows, and of a batch of documents, on average and at most (but for one text alone).
BLOCK, BATCH = 1 << 20, 1 << 20
#: Evidence is summed as integers, so that its order doesn't matter.
SCALE = 1024
_U = np.uint64


def _counted(rows: DataFrame, places: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """How often each place under `size` is among places(bytes, offsets) of all texts; the counts reach the driver.

    Each task sends a row for each place that isn't 0; they are added up by place, so no task holds more than its share of the places.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, _, data, offsets in tb.chunks(batch.column("text")):
                np.add.at(total, places(data, offsets), 1)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 16):
            k = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(total[k])], ["place", "n"])

    got = rows.select("text").mapInArrow(part, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got.column("place").to_numpy()] = got.column("n").to_numpy()
    return out


def _shapes(words: tb.Words) -> np.ndarray:
    """0 to SHAPES - 1: length band, mark at the end, capital at the start, any byte beyond ASCII, any other mark."""
    data, begin, end = words.data, words.begin, words.end
    if not len(begin):
        return np.zeros(0, np.int64)
    band = np.searchsorted([3, 6, 9], end - begin, "left")
    letter = ((data | 0x20) >= 97) & ((data | 0x20) <= 122) | (data >= 0x80)
    sums = np.zeros((2, len(data) + 1), np.int32)
    np.cumsum(~letter, out=sums[0, 1:])
    np.cumsum(data >= 0x80, out=sums[1, 1:])
    marks = sums[0, end] - sums[0, begin]
    ends = ~letter[end - 1]
    upper = (data[begin] >= 65) & (data[begin] <= 90)
    wide = sums[1, end] > sums[1, begin]
    odd = marks - ends > 0
    return band + 4 * ends + 8 * np.where(odd, 3, np.where(upper, 1, np.where(wide, 2, 0)))


def _vocabulary(words: tb.Words) -> tuple[np.ndarray, np.ndarray]:
    """The place of each word in the vocabulary, and its whole hash."""
    hashes = words.hashes(words.begin, words.end)
    return (_shapes(words) << SHAPE_BITS) + (hashes >> _U(64 - SHAPE_BITS)).astype(np.int64), hashes


def _places(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return _vocabulary(tb.Words(data, offsets))[0]


def _beside(words: tb.Words, values: np.ndarray, step: int) -> np.ndarray:
    """The value of the word `step` places on, in the same text; else 0."""
    out = np.zeros(len(values), values.dtype)
    if len(values) > abs(step):
        here, there = (slice(-step, None), slice(None, step)) if step < 0 else (slice(None, -step), slice(step, None))
        out[here] = np.where(words.row[here] == words.row[there], values[there], values.dtype.type(0))
    return out


def _coarse(classes: np.ndarray) -> np.ndarray:
    """Beyond the text, single word, plain shape, shape with a mark at the end."""
    shape = classes - 1 - SINGLES
    return np.where(classes == 0, 0, np.where(shape < 0, 1, np.where(shape // 4 % 2 == 0, 2, 3)))


def _cells(words: tb.Words, classes: np.ndarray) -> np.ndarray:
    """Each word's place among CONTEXTS * CLASSES."""
    context = ((_coarse(_beside(words, classes, -2)) * CLASSES + _beside(words, classes, -1)) * CLASSES + _beside(words, classes, 1)) * COARSE + _coarse(_beside(words, classes, 2))
    return context * CLASSES + classes


def _windows(words: tb.Words, hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A hash of the words on both sides of each word: the nearest, and the next ones too where the nearest are both single words (or ends)."""
    a, b = _beside(words, hashes, -1), _beside(words, hashes, 1)
    out = tb.mixed(a + _U(0x9E3779B97F4A7C15)) + b
    plain = np.flatnonzero((_beside(words, classes, -1) <= SINGLES) & (_beside(words, classes, 1) <= SINGLES))
    wide = tb.mixed(_beside(words, hashes, -2) + _U(0x632BE59BD9B4E019)) ^ tb.mixed(_beside(words, hashes, 2) + _U(0xD1342543DE82EF95))
    out[plain] ^= wide[plain]
    return tb.mixed(out)


def _context_parts() -> list[np.ndarray]:
    c = np.arange(CONTEXTS)
    return [c // (CLASSES * CLASSES * COARSE), c // (CLASSES * COARSE) % CLASSES, c // COARSE % CLASSES, c % COARSE]


def train(counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Log chances of each class in each context (CONTEXTS by CLASSES), from counts of that shape, by Adam.

    The network: an embedding for each of the four places, added up, tanh, and a linear layer to the classes. Contexts that
    don't occur get chances too; class 0, which no word has, gets none. Without any count all others get equal chances.
    """
    rng = np.random.default_rng(SEED)
    parts = _context_parts()
    seen = np.flatnonzero(counts.sum(1))
    if not len(seen):
        out = np.full((CONTEXTS, CLASSES), -np.log(CLASSES - 1), np.float32)
        out[:, 0] = NEVER
        return out
    weight = counts[seen].astype(np.float32) / np.float32(counts.sum())
    mass = weight.sum(1, keepdims=True)
    at = [p[seen] for p in parts]
    sizes = [COARSE, CLASSES, CLASSES, COARSE]
    hot = [np.zeros((len(seen), n), np.float32) for n in sizes]
    for h, a in zip(hot, at, strict=True):
        h[np.arange(len(seen)), a] = 1
    inputs = np.concatenate(hot, 1)
    params = [rng.normal(0, 0.3, (sum(sizes), HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, 0.1, (HIDDEN, CLASSES)).astype(np.float32), np.log(weight.sum(0) + 1e-6).astype(np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for i in range(1, steps + 1):
        hidden = np.tanh(inputs @ params[0] + params[1])
        scores = hidden @ params[2] + params[3]
        scores -= scores.max(1, keepdims=True)
        np.exp(scores, out=scores)
        back = scores / scores.sum(1, keepdims=True) * mass - weight
        inner = back @ params[2].T * (1 - hidden**2)
        grads = [inputs.T @ inner, inner.sum(0), hidden.T @ back, back.sum(0)]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            params[k] -= RATE * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-8)
    places = np.cumsum([0, *sizes])
    hidden = np.tanh(sum(params[0][places[k] + p] for k, p in enumerate(parts)) + params[1])
    out = hidden @ params[2] + params[3]
    out[:, 0] = NEVER
    out -= out.max(1, keepdims=True)
    out -= np.log(np.exp(out).sum(1, keepdims=True))
    return out.astype(np.float32)


class Model:
    """classes: of each word of the vocabulary; cells: log chances of classes in contexts; shares: log chance of each word within its class; n_words: in the corpus."""

    def __init__(self, classes: np.ndarray, cells: np.ndarray, shares: np.ndarray, n_words: int):
        self.classes, self.cells, self.shares, self.n_words = classes, cells, shares, n_words

    def prior(self, words: tb.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: its log chance by the network, its place in the vocabulary, and its window."""
        at, hashes = _vocabulary(words)
        classes = self.classes[at]
        return self.cells[_cells(words, classes)] + self.shares[at], at, _windows(words, hashes, classes)


def fit(docs: DataFrame) -> Model:
    """The network of all texts of docs (doc_id, text)."""
    counts = _counted(docs, _places, VOCABULARY)
    classes = 1 + SINGLES + (np.arange(VOCABULARY) >> SHAPE_BITS)
    top = np.lexsort((np.arange(VOCABULARY), -counts))[:SINGLES]
    top = top[counts[top] > 0]
    classes[top] = np.arange(1, len(top) + 1)
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def cells_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        w = tb.Words(data, offsets)
        return _cells(w, shared.value[_vocabulary(w)[0]])

    cells = train(_counted(docs, cells_of, CONTEXTS * CLASSES).reshape(CONTEXTS, CLASSES)).reshape(-1)
    smooth = counts + SMOOTHING
    totals = np.bincount(classes, smooth, CLASSES)
    return Model(classes, cells, np.log(smooth / totals[classes]).astype(np.float32), int(counts.sum()))


def _blocks(n_words: int) -> int:
    return max(1, -(-n_words // BLOCK))


def _dealt(model: object, blocks: int, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch of documents a row with their ids, word counts and sums of prior log chances; for each block a row with the places dealt to it."""
    from pyspark import TaskContext

    part, number, batch = TaskContext.get().partitionId(), 0, []
    names = ["block", "batch", "ids", "counts", "sums", "places"]

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal number, batch
        key = (part << 32) + number
        number += 1
        ids = pa.concat_arrays([b[0] for b in batch])
        of, logs, at, windows = (np.concatenate([b[k] for b in batch]) for k in range(1, 5))
        counts, sums = np.bincount(of, minlength=len(ids)), np.bincount(of, logs, len(ids))
        kind = pa.list_(ids.type)
        batch = []
        to = ((windows >> _U(32)) % _U(blocks)).astype(np.uint16 if blocks <= 1 << 16 else np.int64)
        order = np.argsort(to, kind="stable")
        ends = np.flatnonzero(np.diff(to[order], append=-1))
        made: list[tuple[int, bytes]] = []
        first = 0
        low, at, logs, of = (windows & _U(0xFFFFFFFF)).astype(np.uint32)[order], at.astype(np.uint32)[order], logs.astype(np.float16)[order], of.astype(np.uint16)[order]
        for end in ends + 1 if len(order) else ():
            k = slice(first, end)
            made.append((int(to[order[first]]), low[k].tobytes() + _packed(at[k]) + logs[k].tobytes() + of[k].tobytes()))
            first = end
        yield pa.RecordBatch.from_arrays([pa.array([key % blocks], pa.int64()), pa.array([key], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([sums.tolist()], pa.list_(pa.float64())), pa.array([None], pa.binary())], names)
        if made:
            none = [pa.nulls(len(made), t) for t in (kind, pa.list_(pa.int64()), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([key] * len(made), pa.int64()), *none, pa.array([m[1] for m in made], pa.binary())], names)

    rows = words = 0
    for arrow in batches:
        ids = arrow.column("doc_id")
        for first, last, data, offsets in tb.chunks(arrow.column("text")):
            w = tb.Words(data, offsets)
            if batch and (words + len(w.row) > most or rows + last - first >= 1 << 16):
                yield from flush()
                rows = words = 0
            for a in range(first, last, 1 << 15):  # rows of a chunk may all be empty
                b = min(last, a + (1 << 15))
                mine = (w.row >= a - first) & (w.row < b - first)
                if rows + b - a >= 1 << 16:
                    yield from flush()
                    rows = words = 0
                if a == first:
                    values = model.value.prior(w)
                batch.append((ids.slice(a, b - a), w.row[mine] - (a - first) + rows, *(v[mine] for v in values)))
                rows += b - a
                words += int(mine.sum())
    if batch:
        yield from flush()


def _packed(at: np.ndarray) -> bytes:
    """Integers under 2**24 as three bytes each."""
    return np.ascontiguousarray(at.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def _unpacked(blob: memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window, vocabulary place, log prior and document of each place."""
    n = len(blob) // 11
    wide = np.zeros((n, 4), np.uint8)
    wide[:, :3] = np.frombuffer(blob, np.uint8, 3 * n, 4 * n).reshape(n, 3)
    tail = np.frombuffer(bytes(blob[7 * n :]), np.uint16)
    return np.frombuffer(blob, np.uint32, n), wide.view("<u4").reshape(-1), tail[:n].view(np.float16), tail[n:]


def evidence(windows: np.ndarray, at: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """What the other places with the same window add to each place's log chance, times SCALE; 0 where there are none."""
    key = (windows.astype(np.uint64) << _U(24)) | at.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    out = np.zeros(len(key), np.int64)
    if not len(key):
        return out
    places = np.arange(len(key))
    lengths = []
    for k in (key >> _U(24), key):
        new = np.concatenate([[True], k[1:] != k[:-1]])
        run = np.cumsum(new) - 1
        lengths.append(np.diff(np.append(places[new], len(key)))[run])
    n, k = (x - 1.0 for x in lengths)
    prior = logs[order].astype(np.float64)
    seen = n > 0
    gain = np.log((k[seen] + WEIGHT * np.exp(prior[seen])) / (n[seen] + WEIGHT)) - prior[seen]
    out[order[seen]] = np.rint(gain * SCALE).astype(np.int64)
    return out


def _met(group: pa.Table) -> pa.Table:
    """The documents that came along, and for each batch what the places of this block add to its documents."""
    came = group.filter(pa.compute.is_null(group.column("places")))
    found = [(b.as_py(), _unpacked(x.as_buffer())) for b, x in zip(group.column("batch"), group.column("places"), strict=True) if x.is_valid]
    names = ["batch", "ids", "counts", "sums", "of", "gains"]
    of, gains, keys = [], [], []
    if found:
        gain = evidence(*(np.concatenate([f[1][k] for f in found]) for k in range(3)))
        first = 0
        for key, (_, _, _, docs) in found:
            mine = gain[first : first + len(docs)]
            first += len(docs)
            some = np.flatnonzero(mine)
            if len(some):
                sums = np.bincount(docs[some], mine[some])
                at = np.flatnonzero(sums)
                keys.append(key)
                of.append(at.astype(np.int32))
                gains.append(np.rint(sums[at]).astype(np.int64))
    lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, t), *x]), k)) for x, t, k in ((of, np.int32, pa.int32()), (gains, np.int64, pa.int64()))]
    made = pa.table([pa.array(keys, pa.int64()), *(pa.nulls(len(keys), group.schema.field(n).type) for n in names[1:4]), *lists], names)
    came = pa.table([*(came.column(n) for n in names[:4]), pa.nulls(len(came), pa.list_(pa.int32())), pa.nulls(len(came), pa.list_(pa.int64()))], names)
    return pa.concat_tables([came, made])


def _returned(group: pa.Table) -> pa.Table:
    """The documents of a batch with their scores."""
    head = group.filter(pa.compute.is_valid(group.column("ids")))
    row = {n: head.column(n)[0] for n in ("ids", "counts", "sums")}
    counts = row["counts"].values.to_numpy(zero_copy_only=False)
    total = np.zeros(len(counts), np.int64)
    for of, gains in zip(group.column("of"), group.column("gains"), strict=True):
        if of.is_valid:
            np.add.at(total, of.values.to_numpy(), gains.values.to_numpy())
    scores = row["sums"].values.to_numpy(zero_copy_only=False) + total / SCALE
    return pa.table([row["ids"].values, pa.array(counts, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "n_tokens", "log_likelihood"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_likelihood, perplexity of each row of docs (doc_id, text), which is the corpus of the evidence too.

    A null or empty text has no tokens, a log-likelihood and mean of 0 and perplexity 1. A text of one word is predicted from its
    two ends. Repeated rows get equal scores, each being evidence for the others. A very long text is a batch of its own. An empty table
    gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    blocks, most = _blocks(model.n_words), BATCH
    kind = docs.schema["doc_id"].dataType
    longs, doubles = T.ArrayType(T.LongType()), T.ArrayType(T.DoubleType())
    heads = [T.StructField("ids", T.ArrayType(kind)), T.StructField("counts", longs), T.StructField("sums", doubles)]
    dealt = T.StructType([T.StructField("block", T.LongType()), T.StructField("batch", T.LongType()), *heads, T.StructField("places", T.BinaryType())])
    met = T.StructType([T.StructField("batch", T.LongType()), *heads, T.StructField("of", T.ArrayType(T.IntegerType())), T.StructField("gains", longs)])
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("log_likelihood", T.DoubleType())])
    rows = docs.select("doc_id", "text").mapInArrow(lambda batches: _dealt(shared, blocks, most, batches), dealt)
    rows = rows.groupBy("block").applyInArrow(_met, met).groupBy("batch").applyInArrow(_returned, out)
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).otherwise(F.lit(0.0))
    return rows.withColumn("mean_log_likelihood", mean).withColumn("perplexity", F.exp(-F.col("mean_log_likelihood")))


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents under the network trained on all documents, with all documents as evidence."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, fit(docs))
