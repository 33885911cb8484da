"""Vectorised word, shingle and window hashing over the UTF-8 bytes of an Arrow column.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. No multi-byte UTF-8
character holds such a byte, so the byte rule and the character rule
``[^\\x20\\x09-\\x0D]+`` find the same words. Hashes are 64 bits wide, depend only on
the word's bytes and are the same in every process, so they may be joined on. Words of
LONG_WORD bytes and more are hashed by BLAKE2: a polynomial modulo 2**64 gives some pairs
of long words, made for it, one value whatever its odd base.

Nulls count as empty texts and yield no word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 18
#: Bytes from which on a word is long.
LONG_WORD = 128

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_SAME = np.arange(1, 257, dtype=np.uint64)
_LOWER = _SAME.copy()
_LOWER[65:91] = _SAME[97:123]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; a bijection."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(n + 1, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of the base and of its inverse modulo 2**64."""
    return _powers(max(STEP_BYTES * 2, 1 << int(n).bit_length()))


@dataclass
class Words:
    """The words of the rows [first, first + n_rows) of a column."""

    first: int
    n_rows: int
    data: np.ndarray  # bytes of the rows
    offsets: np.ndarray  # n_rows + 1 places in data
    starts: np.ndarray  # of words, in data
    ends: np.ndarray
    row: np.ndarray  # of each word, from 0
    hashes: np.ndarray

    @property
    def bounds(self) -> np.ndarray:
        """n_rows + 1 places in the word arrays."""
        return np.searchsorted(self.row, np.arange(self.n_rows + 1))

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def utf8_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words_of(column: pa.Array, lower: bool = False, limit: int = STEP_BYTES) -> Iterator[Words]:
    """The words of every row, a few rows at a time."""
    raw, offsets = utf8_of(column)
    table = _LOWER if lower else _SAME
    table_bytes = (table - np.uint64(1)).astype(np.uint8)
    for i, j in steps(offsets, limit):
        data = raw[offsets[i] : offsets[j]]
        offs = offsets[i : j + 1] - offsets[i]
        n = len(data)
        solid = ~_IS_SPACE[data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[offs] = True
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = solid[:-1]
        starts = np.flatnonzero(solid & (~before | cut[:n]))
        after = np.empty(n, dtype=bool)
        if n:
            after[-1] = False
            after[:-1] = solid[1:]
        ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
        power, inverse = powers(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(table[data] * power[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        for w in np.flatnonzero(ends - starts >= LONG_WORD):
            hashes[w] = int.from_bytes(blake2b(table_bytes[data[starts[w] : ends[w]]].tobytes(), digest_size=8).digest(), "little")
        row = (np.searchsorted(offs, starts, side="right") - 1).astype(np.int64)
        yield Words(i, j - i, data, offs, starts, ends, row, hashes)


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each place on; len(hashes) - k + 1 of them."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for x in range(k):
        out = out * np.uint64(_BASE) + hashes[x : x + m]
    return mix(out + np.uint64(k))


def shingles_of(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles as (row, hash), sorted by row, then hash.

    A row with 1 to k - 1 words has its whole word sequence as its one shingle; a row
    without words has none.
    """
    h, row = run_hashes(words.hashes, k), words.row
    keep = row[: len(h)] == row[k - 1 :] if len(h) else np.zeros(0, bool)
    rows, hashes = row[: len(h)][keep], h[keep]
    bounds = words.bounds
    counts = np.diff(bounds)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        own = [run_hashes(words.hashes[bounds[i] : bounds[i + 1]], int(counts[i]))[0] for i in short]
        rows, hashes = np.concatenate([rows, short]), np.concatenate([hashes, np.array(own, np.uint64)])
        order = np.argsort(rows, kind="stable")
        rows, hashes = rows[order], hashes[order]
    cuts = np.searchsorted(rows, np.arange(words.n_rows + 1))
    hashes = hashes.copy()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        hashes[a:b].sort()
    if len(rows):
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        rows, hashes = rows[new], hashes[new]
    return rows, hashes
