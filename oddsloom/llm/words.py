"""Words, hashes and shingles of whole Arrow batches, computed with numpy.

A word is a maximal run of bytes other than space and \\x09-\\x0D, after A-Z are lower-cased where asked for.
Everything works on the UTF-8 buffer of the batch, so the cost per byte is a few vector operations and no
Python object is made per word.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NO_LETTER = np.zeros(256, bool)  # ASCII other than digits and small letters
NO_LETTER[:128] = True
NO_LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
FOLD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2127599BF4325C37], np.uint64)
PIECE = 1 << 20  # bytes hashed at a time
_powers = np.ones(1, np.uint64)


class Words(NamedTuple):
    """Words of a batch: first[i]:first[i+1] are the words of row i; starts and ends point into data."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its rows' offsets into them; null counts as empty."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(column: pa.Array, lower: bool = True, breaks: np.ndarray = SPACE) -> Words:
    """The words of a batch: runs of bytes that ``breaks`` doesn't mark."""
    data, offsets = text_bytes(column)
    if lower:
        data = LOWER[data]
    inside = ~breaks[data]
    edge = np.zeros(len(data) + 1, bool)  # a row begins here
    edge[offsets] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, BASE)]))
    return _powers


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of every word, a polynomial of its bytes, mixed."""
    data, starts, ends, _ = words
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    power = _power(int((ends - starts).max()) + 1)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + PIECE)))
        size = ends[at:to] - starts[at:to]
        before = np.concatenate([[0], np.cumsum(size)[:-1]])
        place = np.arange(size.sum()) - np.repeat(before, size)
        byte = data[np.repeat(starts[at:to], size) + place].astype(np.uint64) + np.uint64(1)
        out[at:to] = np.add.reduceat(byte * power[place], before)
        at = to
    return mix(out)


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive words of the batch; callers cut the rows apart."""
    n = max(0, len(hashes) - k + 1)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * FOLD[j]
    return mix(total)


def short_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """The one shingle of a row with fewer than k words, apart from every run of k words."""
    return mix(np.array([(hashes * FOLD[: len(hashes)]).sum(dtype=np.uint64) ^ FOLD[k - 1] ^ np.uint64(len(hashes))]))
