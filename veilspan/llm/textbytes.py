"""Vectorised statistics of texts, taken from the UTF-8 bytes of Arrow batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; one longer text is worked on alone.
CHUNK = 1 << 17
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_U = np.uint64
#: An odd base of the polynomial hash modulo 2**64 and its inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.empty(max(n, CHUNK + 1), np.uint64)
        have[0] = 1
        have[1:] = base
        np.multiply.accumulate(have, out=have)
        if len(have) <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of x changes half the bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows first to last (exclusive) with their bytes and offsets into these; null is empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        last = min(last, len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def by_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags each row's bytes have."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])


class Words:
    """Where the words of some rows stand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        solid = ~SPACE[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1] | first[1:-1]
        ends[:-1] &= ~solid[1:] | first[1:-1]
        self.solid = solid
        self.begin, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.row = np.searchsorted(offsets, self.begin, "right") - 1
        self.count = np.bincount(self.row, minlength=self.rows).astype(np.int64)
        self._sums: np.ndarray | None = None

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges, from sums of powers."""
        if self._sums is None:
            terms = (self.data.astype(np.uint64) + _U(1)) * powers(_BASE, len(self.data))
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(terms, out=self._sums[1:])
        return mixed((self._sums[end] - self._sums[begin]) * powers(_INVERSE, len(self.data) + 1)[begin] + (end - begin).astype(np.uint64))


def _seen_again(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    order = np.argsort(keys)
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    out = np.empty(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out


def _distinct(keys: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Distinct keys of each row."""
    keys = mixed(keys ^ (row.astype(np.uint64) * _U(_BASE)))
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    return np.bincount(row[order][new], minlength=rows).astype(np.int64)


def repeated_words(words: Words, hashes: np.ndarray, length: int = 8) -> np.ndarray:
    """Words of each row inside a run of `length` words that the row holds twice or more."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(words.rows, np.int64)
    run = np.zeros(n, np.uint64)
    for i in range(length):
        run = run * _U(_INVERSE) + hashes[i : i + n]
    inside = words.row[:n] == words.row[length - 1 :]
    at = np.flatnonzero(inside)
    again = at[_seen_again(mixed(run[at] ^ (words.row[at].astype(np.uint64) * _U(_BASE))))]
    steps = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(steps, again, 1)
    np.add.at(steps, again + length, -1)
    covered = np.cumsum(steps[:-1]) > 0
    return np.bincount(words.row[covered], minlength=words.rows).astype(np.int64)


def repeated_lines(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier line of their row."""
    data, offsets = words.data, words.offsets
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    begin = begin[begin < len(data)]
    if not len(begin):
        return np.zeros(words.rows, np.int64), np.zeros(words.rows, np.int64)
    # a line ends at its break or with its row
    row = np.searchsorted(offsets, begin, "right") - 1
    end = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, begin, "left")], offsets[row + 1])
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(words.solid, out=solid[1:])
    has = solid[end] > solid[begin]
    begin, end, row = begin[has], end[has], row[has]
    lines = np.bincount(row, minlength=words.rows).astype(np.int64)
    return lines, lines - _distinct(words.hashes(begin, end), row, words.rows)


#: What statistics() returns, all of them counts.
STATISTICS = ("n_chars", "n_words", "word_chars", "n_symbols", "n_upper", "n_digits", "n_marks", "n_wide", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_short_words", "n_marked_words")


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """STATISTICS of each row."""
    w = Words(data, offsets)
    head = (data & 0xC0) != 0x80
    wide = data >= 0x80
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    letter = upper | ((data >= 97) & (data <= 122)) | wide
    symbol = SYMBOL[data]
    hashes = w.hashes(w.begin, w.end)
    lines, dup = repeated_lines(w)
    last = ~letter[w.end - 1] & ~digit[w.end - 1] if len(w.end) else np.zeros(0, bool)
    odd = last & (w.end - w.begin > 1)
    if len(w.end):
        odd &= ~letter[np.maximum(w.end - 2, w.begin)] & ~digit[np.maximum(w.end - 2, w.begin)]
    return {
        "n_chars": by_row(head, offsets),
        "n_words": w.count,
        "word_chars": by_row(w.solid & head, offsets),
        "n_symbols": by_row(symbol, offsets),
        "n_upper": by_row(upper, offsets),
        "n_digits": by_row(digit, offsets),
        "n_marks": by_row(w.solid & ~letter & ~digit, offsets),
        "n_wide": by_row(wide & head, offsets),
        "n_lines": lines,
        "n_dup_lines": dup,
        "n_repeat_words": repeated_words(w, hashes),
        "n_distinct_words": _distinct(hashes, w.row, w.rows),
        "n_short_words": np.bincount(w.row[w.end - w.begin <= 2], minlength=w.rows).astype(np.int64),
        "n_marked_words": np.bincount(w.row[odd], minlength=w.rows).astype(np.int64),
    }
