"""Vectorised word hashes and rolling hashes of word windows over a block of documents.

Hashes are polynomials modulo 2^64 over random byte values, finished with a mixer; a seed gives an independent family.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of text hashed at a time.
PIECE = 1 << 18
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """Words of a column of texts: ``data`` bytes, ``starts``/``ends`` of words, and word ranges ``first[i]:first[i+1]`` of row i."""

    def __init__(self, texts: pa.ChunkedArray, lower: bool = False):
        array = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        values = [b"" if x is None else x for x in array.cast(pa.large_binary()).to_pylist()]
        data = np.frombuffer(b"\n" + b"\n".join(values) + b"\n", np.uint8)
        self.data = LOWER[data] if lower else data
        sizes = np.fromiter(map(len, values), np.int64, len(values))
        self.row_start = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])[: len(values) + 1]
        inside = ~SEPARATORS[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.ends = edges[::2], edges[1::2]
        self.first = np.searchsorted(self.starts, self.row_start)
        self.n = np.diff(self.first)

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit hash of each word, computed piece by piece to keep the tables of powers small."""
        values, base, inverse = _family(seed)
        out = np.empty(len(self.starts), np.uint64)
        cuts = np.append(np.flatnonzero(np.diff(self.starts // PIECE, prepend=-1)), len(self.starts))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            begin, end = int(self.starts[lo]), int(self.ends[hi - 1])
            power, unpower = _powers(base, end - begin), _powers(inverse, end - begin)
            total = np.zeros(end - begin + 1, np.uint64)
            found = np.take(values, self.data[begin:end])
            found *= power
            np.cumsum(found, out=total[1:])
            starts = self.starts[lo:hi] - begin
            sums = np.take(total, self.ends[lo:hi] - begin)
            sums -= np.take(total, starts)
            sums *= np.take(unpower, starts)
            out[lo:hi] = mix(sums)
        return out

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.n)), self.n)


def windows(hashes: np.ndarray, size: int, seed: int) -> np.ndarray:
    """The hash of every ``size`` consecutive words, wherever they start (across rows too: the caller masks those)."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    _, base, inverse = _family(seed + 7919)
    power, unpower = _powers(base, n), _powers(inverse, n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * power, out=total[1:])
    return mix((total[size:] - total[:-size]) * unpower[: n - size + 1])


def starts_in_row(words: Words, size: int) -> np.ndarray:
    """Whether the ``size`` words from here on are of one row, for each word that ``windows`` has a hash of."""
    n = len(words.starts)
    if n < size:
        return np.zeros(0, bool)
    last = np.repeat(words.first[1:], words.n)
    return np.arange(n - size + 1) + size <= last[: n - size + 1]


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values."""
    if len(values) < size:
        return np.zeros(0, values.dtype)
    out, width = values, 1
    while width * 2 <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = size - width
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=16)
def _family(seed: int) -> tuple[np.ndarray, int, int]:
    made = np.random.default_rng(seed)
    values = made.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = int(made.integers(2**61, 2**62)) * 4 + 3
    return values, base % 2**64, pow(base, -1, 2**64)


_kept: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _kept.get(base)
    if have is None or len(have) < n:
        if len(_kept) > 8:
            _kept.clear()
        steps = np.full(max(n, 1), base, np.uint64)
        steps[0] = 1
        have = _kept[base] = np.cumprod(steps)
    return have[:n]
