"""Removal of repeated 50-byte strings by a distributed merge sort of suffixes that knows common prefixes.

Any LENGTH-byte string holds a GRAM-byte string with the least hash among its grams, and equal strings hold it at the same
place; so it's enough to sort the suffixes that start at such places (one in 18 bytes or so). Each task sorts its suffixes, cut
at LENGTH bytes, and writes them front-coded: the length of the prefix shared with the one before, and the rest. Runs are
exchanged by gram, and each set of runs is combined by a loser tree that keeps, for every loser, the prefix it shares with
its winner: the longer prefix wins without comparison, and only equally long ones are compared, from there on.

In the merged order the suffixes of one gram lie together. For each, the bytes before it are at hand too, and every string of
LENGTH bytes around the gram is looked up among those of smaller ids. Suffixes with the same bytes on both sides are settled inside a
task, but for the smallest id, so a passage that many documents share is exchanged once for each task.

A text that equals one of a smaller id is removed whole, without being sorted, as all its strings start there. Of the others, a
first pass finds the grams that stand in two texts, so that only their suffixes are exchanged: each piece of a task sends its
distinct grams, dealt out by hash into blocks, and the blocks answer which of them other pieces have too; the answers go back to the piece, and
from there to its texts. Nothing of this is held by the driver or by all tasks, so one path serves every size.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import textbytes as tb
from .common import bounded_batches, written

LENGTH, GRAM = 50, 16
#: Places at which the gram may stand in a string, less one: also the bytes kept before a suffix.
LEFT = LENGTH - GRAM
HASH_BITS = 48
#: The most spans to remove (16 bytes each) in a broadcast; beyond, the join shuffles.
SPAN_ROWS = 2_000_000
#: Bytes of text whose grams (one in 18 bytes or so) are counted in one block.
BLOCK_BYTES = 8 << 20
#: The most texts of a piece.
PIECE_TEXTS = (1 << 16) - 1
#: Suffixes merged in one task, about; suffixes sorted into one run; and grams counted in one piece.
MERGED, RUN, GRAMS_AT_ONCE = 60_000, 100_000, 1_000_000
#: Keys of texts that occur more than once are broadcast up to this number (about 50 bytes each); beyond, the join shuffles.
BROADCAST_COPIES = 200_000
#: Larger groups are looked up by string instead of pair by pair.
PAIRWISE = 8
NO_ID = (1 << 63) - 1


def _slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """best over each `width` consecutive values, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = best(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of grams with the least hash in some string of LENGTH bytes inside a row, and their hashes."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * tb.powers(tb._BASE, len(data)), out=sums[1:])
    hashes = tb.mixed((sums[GRAM:] - sums[:-GRAM]) * tb.powers(tb._INVERSE, len(data) + 1)[: len(data) - GRAM + 1]) >> np.uint64(64 - HASH_BITS)
    hashes += np.uint64(1)
    least = _slide(hashes, LEFT + 1, np.minimum)[:n]
    room = np.repeat(offsets[1:], np.diff(offsets))[:n] - np.arange(n)
    least[room < LENGTH] = 0
    padded = np.zeros(n + 2 * LEFT, np.uint64)
    padded[LEFT : LEFT + n] = least
    most = _slide(padded, LEFT + 1, np.maximum)
    at = np.flatnonzero(most == hashes[: len(most)])
    return at, hashes[at]


def _ids(column: pa.Array) -> np.ndarray:
    """Null ids come after all others."""
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _grams(blocks: int, at_once: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each piece of the task a row with its texts and the grams that stand in two of them, and by block a row with its distinct grams."""
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    ids, marks, hashes, owners, n, texts = [], [], [], [], 0, 0
    for batch in batches:
        doc, mark = _ids(batch.column("doc_id")), np.asarray(batch.column("mark"))
        for first, last, data, offsets in tb.chunks(batch.column("text")):
            for a in range(first, last, PIECE_TEXTS):
                b = min(last, a + PIECE_TEXTS)
                if texts and (texts + b - a > PIECE_TEXTS or n >= at_once):
                    yield _piece((part << 32) + number, blocks, *map(np.concatenate, (ids, marks, hashes, owners)))
                    number += 1
                    ids, marks, hashes, owners, n, texts = [], [], [], [], 0, 0
                if a == first:
                    at, h = anchors(data, offsets)
                    row = np.searchsorted(offsets, at, "right") - 1 + first
                mine = (row >= a) & (row < b)
                ids.append(doc[a:b])
                marks.append(mark[a:b])
                hashes.append(h[mine] - np.uint64(1))
                owners.append((row[mine] - a + texts).astype(np.uint64))
                n += len(hashes[-1])
                texts += b - a
    if texts:
        yield _piece((part << 32) + number, blocks, *map(np.concatenate, (ids, marks, hashes, owners)))


def _piece(piece: int, blocks: int, ids: np.ndarray, marks: np.ndarray, h: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
    both = np.unique((h << np.uint64(16)) | owner)  # grams of HASH_BITS, texts of 16
    h, owner = both >> np.uint64(16), (both & np.uint64(0xFFFF)).astype(np.uint16)
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    begin = np.flatnonzero(new)
    several = np.diff(np.append(begin, len(h))) > 1
    inside = both[np.repeat(several, np.diff(np.append(begin, len(h))))]
    h, owner = h[begin], np.where(several, np.uint16(0xFFFF), owner[begin])
    width = ((1 << HASH_BITS) - 1) // blocks + 1
    edges = np.searchsorted(h, np.arange(blocks + 1, dtype=np.uint64) * np.uint64(width))
    made = [(k, _packed(h[i:j]), owner[i:j].tobytes()) for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if j > i]
    n = 1 + len(made)
    head = [pa.array([ids.tolist(), *[None] * (n - 1)], pa.list_(pa.int64())), pa.array([marks.tolist(), *[None] * (n - 1)], pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(
        [pa.array([piece % blocks, *(k for k, _, _ in made)], pa.int64()), pa.array([piece] * n, pa.int64()), *head, pa.array([inside.tobytes(), *(x for _, x, _ in made)], pa.binary()), pa.array([None, *(x for _, _, x in made)], pa.binary())],
        ["block", "piece", "ids", "marks", "grams", "owners"],
    )


def _packed(values: np.ndarray) -> bytes:
    """Ascending values as 4-byte steps where these suffice."""
    steps = np.diff(values)
    if len(values) and len(steps) and steps.max() < 1 << 32:
        return b"\x01" + values[:1].tobytes() + steps.astype(np.uint32).tobytes()
    return b"\x00" + values.tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    if blob[:1] == b"\x01":
        steps = np.frombuffer(blob, np.uint32, offset=9).astype(np.uint64)
        return np.concatenate([np.frombuffer(blob, np.uint64, 1, 1), steps]).cumsum(dtype=np.uint64)
    return np.frombuffer(blob, np.uint64, offset=1)


def _answered(group: pa.Table) -> pa.Table:
    """The rows of pieces as they came, and for each piece those of its grams, with their text, that another piece has too."""
    names = ["piece", "ids", "marks", "grams"]
    came = group.filter(pa.compute.is_null(group.column("owners"))).select(names)
    asked = group.filter(pa.compute.is_valid(group.column("owners")))
    found = [_unpacked(b) for b in asked.column("grams").to_pylist()]
    if not found:
        return came
    every = np.sort(np.concatenate(found))
    twice = every[1:][every[1:] == every[:-1]]
    pieces, blobs = [], []
    for piece, h, owners in zip(asked.column("piece").to_pylist(), found, asked.column("owners").to_pylist(), strict=True):
        owner = np.frombuffer(owners, np.uint16)
        same = owner != 0xFFFF  # what stands in two texts of the piece is known there
        if len(twice):
            same &= twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h
            if same.any():
                pieces.append(piece)
                blobs.append(((h[same] << np.uint64(16)) | owner[same]).tobytes())
    made = pa.table([pa.array(pieces, pa.int64()), *(pa.nulls(len(pieces), came.schema.field(n).type) for n in names[1:3]), pa.array(blobs, pa.binary())], names)
    return pa.concat_tables([came, made])


def _returned(group: pa.Table) -> pa.Table:
    """id, mark, grams (ascending, 8 bytes each), n of the piece's texts that share grams."""
    head = group.filter(pa.compute.is_valid(group.column("ids")))
    ids, marks = (np.asarray(head.column(c)[0].values) for c in ("ids", "marks"))
    both = np.concatenate([np.frombuffer(b, np.uint64) for b in group.column("grams").to_pylist()])
    h, owner = both >> np.uint64(16), (both & np.uint64(0xFFFF)).astype(np.int64)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(owner)) if len(begin) else begin
    at = owner[begin]
    return pa.table([pa.array(ids[at]), pa.array(marks[at].astype(np.int32)), pa.array([h[i:j].tobytes() for i, j in zip(begin, end, strict=True)], pa.binary()), pa.array(end - begin, pa.int64())], ["id", "mark", "grams", "n"])


def shared_grams(rows: DataFrame) -> DataFrame:
    """id, mark, grams, n: for each text of rows (doc_id, text, mark) with grams that stand in another text, these."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, at_once = max(1, -(-total // BLOCK_BYTES)), GRAMS_AT_ONCE
    pieces = "piece long, ids array<long>, marks array<int>, grams binary"
    found = rows.mapInArrow(lambda batches: _grams(blocks, at_once, batches), f"block long, {pieces}, owners binary")
    found = found.groupBy("block").applyInArrow(_answered, pieces).groupBy("piece").applyInArrow(_returned, "id long, mark int, grams binary, n long")
    return written(found, "suffix-grams")


_WORDS = 8 * (-(-LENGTH // 8)), 8 * (-(-LEFT // 8))


def _around(data: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The LENGTH bytes from each place and the LEFT before it, within its row and else 0, and how many these are."""
    row = np.searchsorted(offsets, at, "right") - 1
    right_n, left_n = np.minimum(offsets[row + 1] - at, LENGTH), np.minimum(at - offsets[row], LEFT)
    padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(LENGTH, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, LEFT + LENGTH)[at]
    left, right = windows[:, :LEFT].copy(), windows[:, LEFT:].copy()
    left[np.arange(LEFT)[None, :] < (LEFT - left_n)[:, None]] = 0
    right[np.arange(LENGTH)[None, :] >= right_n[:, None]] = 0
    return left, right, left_n.astype(np.uint8), right_n.astype(np.uint8)


def _as_words(x: np.ndarray, width: int) -> list[np.ndarray]:
    """Big-endian integers of eight bytes, so that their order is the bytes'."""
    out = np.zeros((len(x), width), np.uint8)
    out[:, : x.shape[1]] = x
    return list(np.ascontiguousarray(out).view(">u8").astype(np.uint64).T)


def _front_coded(left: np.ndarray, right: np.ndarray, left_n: np.ndarray, right_n: np.ndarray, ids: np.ndarray, marks: np.ndarray, places: np.ndarray) -> bytes:
    """A sorted run: prefixes shared with the one before, the rest of each suffix, and what goes with it."""
    n = len(ids)
    shared = np.zeros(n, np.uint8)
    if n > 1:
        differ = np.concatenate([right[1:] != right[:-1], np.ones((n - 1, 1), bool)], 1).argmax(1)
        shared[1:] = np.minimum(differ, np.minimum(right_n[1:], right_n[:-1]))
    column = np.arange(LENGTH)[None, :]
    rest = right[(column >= shared[:, None]) & (column < right_n[:, None])]
    before = left[np.arange(LEFT)[None, :] >= (LEFT - left_n)[:, None]]
    parts = [shared, right_n, left_n, rest, before, ids, marks, places]
    body = b"".join(p.tobytes() for p in parts)
    return struct.pack("<qqqq", n, len(rest), len(before), len(body)) + pa.compress(body, "zstd", asbytes=True)


class Run:
    """A front-coded run, read one suffix after the other."""

    def __init__(self, blob: bytes):
        n, rest, before, size = struct.unpack_from("<qqqq", blob)
        body = pa.decompress(blob[32:], size, "zstd", asbytes=True)
        take = iter(np.cumsum([0, n, n, n, rest, before, 8 * n, 4 * n]).tolist())
        self.shared = np.frombuffer(body, np.uint8, n, next(take)).tolist()
        right_n = np.frombuffer(body, np.uint8, n, next(take))
        left_n = np.frombuffer(body, np.uint8, n, next(take))
        at, to = next(take), next(take)
        self.rest, self.before = body[at : at + rest], body[to : to + before]
        self.ids = np.frombuffer(body, np.int64, n, next(take)).tolist()
        self.marks = np.frombuffer(body, np.int32, n, next(take)).tolist()
        self.places = np.frombuffer(body, np.int64, n, next(take)).tolist()
        rests = right_n.astype(np.int64) - np.array(self.shared, np.int64)
        self.rest_at = np.concatenate([[0], np.cumsum(rests)]).tolist()
        self.before_at = np.concatenate([[0], np.cumsum(left_n.astype(np.int64))]).tolist()
        self.n, self.i, self.text = n, -1, b""

    def step(self) -> int:
        """Goes to the next suffix; the prefix it shares with the last, or -1 at the end."""
        self.i += 1
        i = self.i
        if i >= self.n:
            return -1
        shared = self.shared[i]
        self.text = self.text[:shared] + self.rest[self.rest_at[i] : self.rest_at[i + 1]]
        return shared

    def item(self) -> tuple[int, int, int, bytes, bytes]:
        i = self.i
        return self.ids[i], self.marks[i], self.places[i], self.before[self.before_at[i] : self.before_at[i + 1]], self.text


def _prefix(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix, of which `known` bytes are known."""
    n = min(len(a), len(b)) - known
    x = int.from_bytes(a[known : known + n], "big") ^ int.from_bytes(b[known : known + n], "big")
    return known + n - (x.bit_length() + 7) // 8


def merged(runs: list[Run]) -> Iterator[tuple[int, tuple[int, int, int, bytes, bytes]]]:
    """All suffixes in order, each after the prefix that it shares with the one before, by a loser tree.

    A run's prefix is always that shared with the last suffix put out; where a run loses, it is that shared with the winner.
    """
    size = 1
    while size < len(runs):
        size *= 2
    prefix = [r.step() for r in runs] + [-1] * (size - len(runs))
    loser = [0] * size

    def winner(a: int, b: int) -> tuple[int, int]:
        """The smaller of two runs and the other, whose prefix becomes that of both."""
        p, q = prefix[a], prefix[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        if p < 0:
            return a, b
        x, y = runs[a].text, runs[b].text
        both = _prefix(x, y, p)
        if x[both : both + 1] <= y[both : both + 1]:
            prefix[b] = both
            return a, b
        prefix[a] = both
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        win, lose = winner(build(2 * node), build(2 * node + 1))
        loser[node] = lose
        return win

    top = build(1)
    while prefix[top] >= 0:
        run = runs[top]
        yield prefix[top], run.item()
        prefix[top] = run.step()
        node = (top + size) // 2
        while node:
            other = loser[node]
            p, q = prefix[top], prefix[other]
            if p < q:
                loser[node], top = top, other
            elif p == q:
                top, loser[node] = winner(top, other)
            node //= 2


def _covered(group: list[tuple[int, tuple[int, int, int, bytes, bytes]]]) -> Iterator[tuple[int, int, int, int]]:
    """id, mark, first byte, last byte + 1 that strings of smaller ids cover, for the suffixes of one gram."""
    least = min(item[0] for _, item in group)
    if all(item[0] == least for _, item in group):
        return
    if len(group) <= PAIRWISE:
        for i, (_, (id_, mark, place, left, right)) in enumerate(group):
            if id_ == least:
                continue
            for k, (_, (other, _, _, left2, right2)) in enumerate(group):
                if other >= id_:
                    continue
                a, b = min(i, k), max(i, k)
                r = min(len(right), min(p for p, _ in group[a + 1 : b + 1]))  # the prefix shared by two is the least between them
                m = min(len(left), len(left2))
                x = int.from_bytes(left[len(left) - m :], "big") ^ int.from_bytes(left2[len(left2) - m :], "big")
                j = m if not x else ((x & -x).bit_length() - 1) // 8
                if j + r >= LENGTH:
                    yield id_, mark, place - j, place + r
        return
    # place by place, so that only one place's strings are held at once
    around: dict[tuple[bytes, bytes], int] = {}
    for _, item in group:
        around[item[3], item[4]] = min(item[0], around.get((item[3], item[4]), NO_ID))
    texts = [(left + right, len(left), len(right), id_) for (left, right), id_ in around.items()]
    place_of = {key: k for k, key in enumerate(around)}
    items = [(place_of[item[3], item[4]], item[0]) for _, item in group]
    hits = [0] * len(items)
    for j in range(LEFT + 1):
        first: dict[bytes, int] = {}
        keys: list[bytes | None] = []
        for text, n, m, id_ in texts:
            key = text[n - j : n - j + LENGTH] if j <= n and LENGTH - j <= m else None
            keys.append(key)
            if key is not None and first.get(key, NO_ID) >= id_:
                first[key] = id_
        for i, (k, id_) in enumerate(items):
            key = keys[k]
            if key is not None and first[key] < id_:
                hits[i] |= 1 << j
    for (_, (id_, mark, place, _, _)), bits in zip(group, hits, strict=True):
        while bits:
            low = (bits & -bits).bit_length() - 1
            length = ((bits >> low) ^ ((bits >> low) + 1)).bit_length() - 1
            high = low + length - 1
            yield id_, mark, place - high, place - low + LENGTH
            bits &= ~(((1 << length) - 1) << low)


def _merge_task(parts: pa.Table) -> pa.Table:
    """The spans to remove that one set of runs shows, and those that were settled before."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    group: list = []

    def settle() -> None:
        if len(group) > 1:
            for span in _covered(group):
                for column, value in zip(out, span, strict=True):
                    column.append(value)

    for shared, item in merged([Run(b) for b in parts.column("run").to_pylist() if b is not None]):
        if shared < GRAM:
            settle()
            group = []
        group.append((shared, item))
    settle()
    settled = parts.filter(pa.compute.is_null(parts.column("run"))).select(["id", "mark", "start", "end"])
    return pa.concat_tables([settled, pa.table([pa.array(c, t) for c, t in zip(out, settled.schema.types, strict=True)], names=settled.column_names)])


def _runs(rows: DataFrame, sets: int) -> DataFrame:
    """bucket, run; or, without a run and under any bucket, id, mark, start, end of a span that is settled inside a task.

    rows: doc_id, text, mark, grams (those whose suffixes count).
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in range(8)]
        n = 0
        for batch in batches:
            doc, mark, grams = _ids(batch.column("doc_id")), np.asarray(batch.column("mark")), batch.column("grams")
            for first, last, data, offsets in tb.chunks(batch.column("text")):
                at, h = anchors(data, offsets)
                if not len(at):
                    continue
                row = np.searchsorted(offsets, at, "right") - 1
                same = np.zeros(len(at), bool)
                edges = np.searchsorted(row, np.arange(last - first + 1))
                for k in range(last - first):
                    i, j = edges[k], edges[k + 1]
                    if j > i:
                        known = np.frombuffer(grams[first + k].as_buffer(), np.uint64)
                        own = h[i:j] - np.uint64(1)
                        same[i:j] = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
                at, h, row = at[same], h[same], row[same]
                if not len(at):
                    continue
                for c, v in zip(cols, [*_around(data, offsets, at), doc[first + row], mark[first + row], at - offsets[row], (h % np.uint64(sets)).astype(np.int32)], strict=True):
                    c.append(v)
                n += len(at)
                if n >= RUN:
                    yield from _sorted_run(sets, *map(np.concatenate, cols))
                    cols, n = [[] for _ in range(8)], 0
        if n:
            yield from _sorted_run(sets, *map(np.concatenate, cols))

    return rows.mapInArrow(part, "bucket int, run binary, id long, mark int, start long, end long")


def _sorted_run(sets: int, left, right, left_n, right_n, ids, marks, places, bucket) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """The spans settled among these suffixes, and a front-coded run for each bucket of the rest."""
    names = ["bucket", "run", "id", "mark", "start", "end"]
    around = [right_n, *_as_words(right, _WORDS[0])[::-1]]
    outer = [left_n, *_as_words(left, _WORDS[1])[::-1]]
    order = np.lexsort([places, marks, ids, *outer, *around, bucket])
    del around, outer
    left, right, left_n, right_n, ids, marks, places, bucket = (x[order] for x in (left, right, left_n, right_n, ids, marks, places, bucket))
    new = np.ones(len(ids), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (right_n[1:] != right_n[:-1]) | (left_n[1:] != left_n[:-1]) | (right[1:] != right[:-1]).any(1) | (left[1:] != left[:-1]).any(1)
    done = ids > ids[np.flatnonzero(new)][np.cumsum(new) - 1]
    if done.any():
        o = np.lexsort((places[done], marks[done], ids[done]))
        i, m = ids[done][o], marks[done][o]
        s, e = (places[done] - left_n[done])[o], (places[done] + right_n[done])[o]
        keep = e - s >= LENGTH
        i, m, s, e = _joined(i[keep], m[keep], s[keep], e[keep])
        yield pa.RecordBatch.from_arrays([pa.array(((i + s) % sets).astype(np.int32)), pa.nulls(len(i), pa.binary()), pa.array(i), pa.array(m), pa.array(s), pa.array(e)], names)
    stay = ~done
    left, right, left_n, right_n, ids, marks, places, bucket = (x[stay] for x in (left, right, left_n, right_n, ids, marks, places, bucket))
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, int)
    blobs = [_front_coded(left[a:b], right[a:b], left_n[a:b], right_n[a:b], ids[a:b], marks[a:b], places[a:b].astype(np.int64)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    if blobs:
        empty = [pa.nulls(len(blobs), t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]], pa.int32()), pa.array(blobs, pa.binary()), *empty], names)


def _joined(ids: np.ndarray, marks: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans sorted by id, mark, start, with those that touch put together."""
    if not len(ids):
        return ids, marks, start, end
    same = (ids[1:] == ids[:-1]) & (marks[1:] == marks[:-1])
    group = np.concatenate([[0], np.cumsum(~same)])
    # ends are made comparable over all rows by lifting each row above the one before
    lift = group * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + lift)
    new = np.concatenate([[True], (start + lift)[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(ids)]]) - 1
    return ids[at], marks[at], start[at], (reach - lift)[last]


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, text, mark (tells texts of one id apart, 0 where an id has one row), copy (whether a smaller id has the same text)."""
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"id": ids, "key": F.md5("text")})
    shared = written(rows.groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("shared")), "suffix-ids")
    rows = rows.join(F.broadcast(shared) if shared.count() <= BROADCAST_COPIES else shared, "id", "left")
    rows = rows.withColumn("mark", F.when(F.col("shared"), F.hash("text")).otherwise(F.lit(0)))
    again = rows.groupBy("key").agg(F.min(ids).alias("least"), F.max(ids).alias("most")).where("most > least").select("key", "least")
    again = written(again, "suffix-copies")
    rows = rows.join(F.broadcast(again) if again.count() <= BROADCAST_COPIES else again, "key", "left")
    return rows.select("doc_id", "text", "mark", F.coalesce(ids > F.col("least"), F.lit(False)).alias("copy"))


def repeated_spans(marked: DataFrame) -> DataFrame:
    """id, mark, starts, ends: for each text of marked (doc_id, text, mark) with repeated strings, the maximal spans to remove, ordered."""
    rows = marked.select("doc_id", "text", "mark").where(F.octet_length("text") >= LENGTH)
    grams = shared_grams(rows)
    n = grams.agg(F.sum("n")).first()[0] or 0
    grams = grams.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), "grams").dropDuplicates(["_id", "_mark"])
    rows = rows.join(grams, (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col("_id")) & (F.col("mark") == F.col("_mark")))
    runs = _runs(rows.select("doc_id", "text", "mark", "grams"), max(24, -(-n // MERGED)))
    spans = runs.groupBy("bucket").applyInArrow(_merge_task, "id long, mark int, start long, end long")
    line = Window.partitionBy("id", "mark").orderBy("start", "end")
    reach = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    spans = spans.withColumn("nth", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("id", "mark", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("id", "mark").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return spans.select("id", "mark", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Each row of docs (doc_id, text) without the bytes that strings of smaller ids cover.

    Returns doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes). A null text is empty; texts under LENGTH bytes stay whole.
    A null doc_id comes after all others, and rows with equal ids don't take from each other. An empty table gives no rows.
    Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    marked = _marked(docs)
    found = written(repeated_spans(marked.where("not copy")), "suffix-spans").withColumnRenamed("mark", "_mark").withColumnRenamed("id", "_id")
    total = found.agg(F.sum(F.size("starts"))).first()[0] or 0
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col("_id")) & (F.col("mark") == F.col("_mark"))
    joined = marked.join(F.broadcast(found) if total <= SPAN_ROWS else found, same, "left").select("doc_id", F.col("text").cast("binary").alias("text"), "copy", "starts", "ends")
    joined = joined.withColumn("copy", F.col("copy") & (F.octet_length("text") >= LENGTH))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, copy, starts, ends in zip(batch.column("text"), batch.column("copy").to_pylist(), batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                text = t.as_buffer().to_pybytes()
                keep, at = [], 0
                if copy:
                    starts, ends = [0], [len(text)]
                for s, e in zip(starts or (), ends or (), strict=True):
                    keep.append(text[at:s])
                    at = e
                kept = b"".join([*keep, text[at:]]) if starts else text
                out.append((len(text), len(text) - len(kept), len(starts or ()), kept))
            n, r, s, k = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, r, s)), pa.array(k, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())]
    return joined.mapInArrow(cut, T.StructType(fields))


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The digest of remove_repeats() over all documents."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(hex(encode(text)), '') AS h, CAST(length(coalesce(hex(encode(text)), '')) // 2 AS BIGINT) AS n FROM documents
), w AS (
  SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS INTEGER), 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM w) WHERE m < doc_id
), run AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hit
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM run) GROUP BY doc_id, k
), cut AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS sa, list(b ORDER BY a) AS sb FROM spans GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN sa IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(sa) + 1),
    lambda k: substr(h, CAST(2 * (CASE WHEN k = 0 THEN 0 ELSE sb[k] END) + 1 AS INTEGER), CAST(2 * ((CASE WHEN k = len(sa) THEN n ELSE sa[k + 1] END) - (CASE WHEN k = 0 THEN 0 ELSE sb[k] END)) AS INTEGER))), '') END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
