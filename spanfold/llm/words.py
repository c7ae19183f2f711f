"""Hashes of the words of many texts at once, for operators whose Python runs on Arrow batches.

Words are ``[^\\x20\\x09-\\x0D]+``. A word's hash is a polynomial over random 64-bit values of its
bytes, scrambled; all words of a stretch come from one running sum, so the cost is a few
array operations per byte and no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once; a longer text is taken in stretches cut at blanks.
STRETCH = 1 << 19

_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(7).integers(1, 2**64, 256, dtype=np.uint64)
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, STRETCH + 1)
        one = np.ones(size, np.uint64)
        up, down = one.copy(), one.copy()
        up[1:], down[1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 2**64))
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null is empty."""
    col = pc.fill_null(col, "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    if not len(col) or offsets is None:
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    ends = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return ends, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def cut_words(raw: np.ndarray, cuts: np.ndarray, values: np.ndarray, is_blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of ``raw``; a word also ends at each of ``cuts``."""
    word = ~is_blank[raw]
    joins = np.zeros(len(raw) + 1, bool)  # True where a byte and the one before it are of one word
    joins[1:-1] = word[1:] & word[:-1]
    joins[cuts] = False
    start, end = np.flatnonzero(word & ~joins[:-1]), np.flatnonzero(word & ~joins[1:]) + 1
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values[raw] * up[: len(raw)], out=total[1:])
    return scramble((total[end] - total[start]) * down[start]), start, end


def _hash_stretch(raw: np.ndarray, cuts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, word starts) of ``raw``; a word also ends at each of ``cuts``."""
    return cut_words(raw, cuts, values, _IS_BLANK)[:2]


def hashed_words(col: pa.Array, lower: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, bounds) for runs of rows: row ``first + k`` has the hashes
    ``[bounds[k] : bounds[k + 1]]``. ``lower``: A-Z count as a-z."""
    offsets, data = text_bytes(col)
    values = _LOWER_BYTE if lower else _BYTE
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = min(rows, max(row + 1, int(np.searchsorted(offsets, offsets[row] + STRETCH, "right")) - 1))
        a, b = offsets[row], offsets[last]
        if b - a <= STRETCH:
            hashes, start = _hash_stretch(data[a:b], offsets[row : last + 1] - a, values)
            bounds = np.searchsorted(start, offsets[row : last + 1] - a)
        else:  # one long text
            parts = []
            while a < b:
                cut = min(a + STRETCH, b)
                while cut < b and not (blank := np.flatnonzero(_IS_BLANK[data[a:cut]])).size:
                    cut = min(cut + STRETCH, b)
                if cut < b:
                    cut = a + int(blank[-1]) + 1
                parts.append(_hash_stretch(data[a:cut], np.array([0, cut - a]), values)[0])
                a = cut
            hashes = np.concatenate(parts)
            bounds = np.array([0, len(hashes)])
        yield row, hashes, bounds
        row = last


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``size`` words in a row, and their bounds per row; a row with fewer words, but
    one at least, has one window: all of them."""
    counts = np.diff(bounds)
    n = len(hashes)
    out = np.zeros(n, np.uint64)
    left = np.repeat(bounds[1:], counts) - np.arange(n)  # words from here to the end of the row
    for k in range(size):
        part = np.zeros(n, np.uint64)
        part[: max(0, n - k)] = hashes[k:]
        step = scramble(out * np.uint64(_BASE) + part + np.uint64(k + 1))
        out = step if not k else np.where(left > k, step, out)
    keep = (left >= size) | (np.arange(n) == np.repeat(bounds[:-1], counts))
    per = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    return out[keep], np.concatenate([[0], np.cumsum(per)])
