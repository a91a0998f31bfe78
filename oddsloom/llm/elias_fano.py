"""Elias-Fano sequences over numpy arrays, with vectorised access and successor search.

A non-decreasing sequence of n values below u keeps the low ``l`` bits of each value packed, and the high bits as a
unary bit vector of at most n + u / 2**l bits; l is about log2(u / n), so a value takes about l + 2 bits. A directory
of set bits per 512-bit block serves select. All arrays may be memory-mapped.
"""

from __future__ import annotations

import json
import mmap
import os

import numpy as np

from .storage import file_system, local_path

U = np.uint64
BLOCK = 2  # words of a directory block
ONE, ALL = U(1), U(0xFFFFFFFFFFFFFFFF)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` bits one after another in 64-bit words, with a spare word."""
    words = np.zeros((len(values) * width + 63) // 64 + 2, U)
    if width:
        place = np.arange(len(values), dtype=np.int64) * width
        at, shift = place >> 6, (place & 63).astype(U)
        # entries that begin in one word never overlap, so their sum is their union
        np.add.at(words, at, values << shift)
        over = (place & 63) + width > 64
        np.add.at(words, at[over] + 1, values[over] >> (U(64) - shift[over]))
    return words


class EliasFano:
    """The arrays of one sequence: ``low`` and ``high`` words, ``ones`` before each block, and (n, l)."""

    def __init__(self, low: np.ndarray, high: np.ndarray, ones: np.ndarray, n: int, width: int):
        self.low, self.high, self.ones, self.n, self.width = low, high, ones, n, width
        self.zeros = None

    @classmethod
    def build(cls, values: np.ndarray, bound: int) -> EliasFano:
        """From non-decreasing unsigned 64-bit values below ``bound``."""
        n = len(values)
        width = max(0, (bound // max(n, 1)).bit_length() - 1)
        values = values.astype(U)
        top = (values >> U(width)).astype(np.int64) if width < 64 else np.zeros(n, np.int64)
        last = (bound >> width) + 1
        bits = np.zeros(((n + last + 1) // (64 * BLOCK) + 1) * 64 * BLOCK, bool)
        bits[top + np.arange(n)] = True
        high = np.packbits(bits, bitorder="little").view(U)
        per = np.bitwise_count(high).astype(np.int64).reshape(-1, BLOCK).sum(axis=1)
        ones = np.concatenate([[0], np.cumsum(per)])
        return cls(_pack(values & U((1 << width) - 1), width), high, ones.astype(np.int64), n, width)

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U)
        place = i * self.width
        at, shift = place >> 6, (place & 63).astype(U)
        left = self.low[at + 1] << ((U(64) - shift) & U(63))
        value = self.low[at] >> shift | np.where(shift == 0, U(0), left)
        return value & U((1 << self.width) - 1)

    def _select(self, k: np.ndarray, before: np.ndarray, flip: np.uint64) -> np.ndarray:
        """Places of the k-th (from 0) bits that are set in high XOR flip."""
        block = np.searchsorted(before, k, "right") - 1
        rest = k - before[block]
        word = block * BLOCK
        bits = self.high[word] ^ flip
        for _ in range(BLOCK - 1):
            here = np.bitwise_count(bits).astype(np.int64)
            go = rest >= here
            if not go.any():
                break
            rest = np.where(go, rest - here, rest)
            word = word + go
            bits = np.where(go, self.high[word] ^ flip, bits)
        place = np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(bits & U((1 << half) - 1)).astype(np.int64)
            go = rest >= low
            rest = np.where(go, rest - low, rest)
            place = place + half * go
            bits = np.where(go, bits >> U(half), bits)
        return word * 64 + place

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        top = (self._select(i, self.ones, U(0)) - i).astype(U)
        return top << U(self.width) | self.lows(i)

    def _bucket(self, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places [low, high) of the values with high part ``top``: a run of set bits between two unset ones."""
        if self.zeros is None:
            self.zeros = np.arange(len(self.ones), dtype=np.int64) * (64 * BLOCK) - self.ones
        top = np.minimum(top, self.zeros[-1] - 1)  # beyond the last value there is nothing
        bit = np.zeros(len(top), np.int64)
        later = top > 0
        bit[later] = self._select(top[later] - 1, self.zeros, ALL) + 1
        low = bit - top
        shift = bit & 63
        rest = self.high[bit >> 6] >> shift.astype(U)
        run = np.bitwise_count(rest & ~(rest + ONE)).astype(np.int64)
        high = low + run
        long = np.flatnonzero(run + shift >= 64)  # goes on in the next word
        high[long] = self._select(top[long], self.zeros, ALL) - top[long]
        return low, high

    def _search(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each value the first place with its high part and no smaller low part, the end of its bucket and its low part."""
        want = values & U((1 << self.width) - 1)
        low, end = self._bucket((values >> U(self.width)).astype(np.int64))
        high = end.copy()
        active = np.flatnonzero(low < high)
        while len(active):
            a, b = low[active], high[active]
            middle = (a + b) >> 1
            less = self.lows(middle) < want[active]
            a = np.where(less, middle + 1, a)
            b = np.where(less, b, middle)
            low[active], high[active] = a, b
            active = active[a < b]
        return low, end, want

    def find(self, values: np.ndarray) -> np.ndarray:
        """The first place of the least value that is not below each of ``values`` (n if there is none)."""
        return self._search(values)[0]

    def index(self, values: np.ndarray) -> np.ndarray:
        """Places of ``values``, -1 where the sequence does not hold them."""
        at, end, want = self._search(values)
        found = np.full(len(values), -1, np.int64)
        inside = np.flatnonzero(at < end)
        hit = inside[self.lows(at[inside]) == want[inside]]
        found[hit] = at[hit]
        return found

    def arrays(self, name: str) -> dict:
        return {f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": self.ones}

    @classmethod
    def of(cls, file: dict, name: str) -> EliasFano:
        return cls(file[f"{name}.low"], file[f"{name}.high"], file[f"{name}.ones"], *file[name])


def write_arrays(uri: str, arrays: dict[str, np.ndarray], values: dict) -> None:
    """One file: length of the head (u64), the head in JSON, the arrays at multiples of 8 bytes."""
    place, head = 0, {}
    for name, a in arrays.items():
        head[name] = [a.dtype.str, place, len(a)]
        place += -(-a.nbytes // 8) * 8
    raw = json.dumps({"arrays": head, "values": values}).encode()
    raw += b" " * (-len(raw) % 8)
    fs, path = file_system(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(path, compression=None) as out:
        out.write(len(raw).to_bytes(8, "little") + raw)
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes() + bytes(-a.nbytes % 8))


def open_arrays(uri: str) -> dict:
    """The arrays and values of a file, mapped into memory where the shared folder is mounted, else read."""
    path = local_path(uri)
    if path:
        with open(path, "rb") as f:
            raw = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)
    else:
        fs, path = file_system(uri)
        with fs.open_input_file(path) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    size = int(raw[:8].view("<u8")[0])
    head = json.loads(raw[8 : 8 + size].tobytes())
    out = dict(head["values"])
    for name, (kind, place, n) in head["arrays"].items():
        start = 8 + size + place
        out[name] = raw[start : start + n * np.dtype(kind).itemsize].view(kind)
    return out
