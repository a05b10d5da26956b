"""Words of Arrow string columns as 64-bit hashes, computed on whole byte buffers.

A column is cut at row borders into pieces of about ``PIECE`` bytes, so the temporaries stay
small whatever the batch size; one very long text is one piece.  Word borders are single
bytes below 0x80 in both word forms, so the UTF-8 bytes need no decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20

# fixed values: bytes between words of the two word forms
_ALL = np.arange(256)
SPACE = (_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D))
NOT_ALNUM = (_ALL < 0x80) & ~(((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)))
LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = mix((_ALL.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, PIECE + (PIECE >> 2))
        made = []
        for base in (_BASE, _BASE_INV):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            made.append(np.cumprod(t))
        _powers = (made[0], made[1])
    return _powers


class Words:
    """Words of consecutive rows: per word its hash and row, per row its first word and count."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, seps: np.ndarray):
        n, size = len(offsets) - 1, len(data)
        low = LOWER[data]
        sep = seps[low]
        inside = ~sep
        begins, ends = inside.copy(), inside.copy()
        if size:
            begins[1:] &= sep[:-1]
            ends[:-1] &= sep[1:]
            borders = offsets[1:-1]
            borders = borders[(borders > 0) & (borders < size)]
            begins[borders] = inside[borders]
            ends[borders - 1] = inside[borders - 1]
        self.begin, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        power, inverse = _power_tables(size + 1)
        total = np.cumsum(_BYTE[low] * power[:size])
        if len(self.begin):
            before = np.where(self.begin > 0, total[self.begin - 1], np.uint64(0))
            self.hash = mix((total[self.end - 1] - before) * inverse[self.begin] + (self.end - self.begin).astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.begin, offsets[:-1])
        self.count = np.diff(np.append(self.first, len(self.begin))) if n else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(n), self.count)
        self.low = low


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words; shorter input gives none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(_BASE)
        out += hashes[j:j + n]
    return mix(out + np.uint64(k))


def row_grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word place in the piece) of the k-grams that stay inside their row."""
    g = grams(w.hash, k)
    if not len(g):
        return g, np.zeros(0, np.int64)
    at = np.flatnonzero(w.row[:len(g)] == w.row[k - 1:])
    return g[at], at


def pieces(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of a string column; null is empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    at = 0
    for chunk in chunks:
        if not len(chunk):
            continue
        if chunk.null_count:
            chunk = chunk.fill_null("")
        chunk = chunk.cast(pa.large_string())
        _, off, data = chunk.buffers()
        offsets = np.frombuffer(off, np.int64)[chunk.offset:chunk.offset + len(chunk) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i, n = 0, len(chunk)
        while i < n:
            j = int(np.searchsorted(offsets, offsets[i] + PIECE, side="right")) - 1
            j = min(max(j, i + 1), n)
            yield at + i, at + j, raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            i = j
        at += n
