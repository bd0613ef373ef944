"""Vectorised words, word hashes and shingles of Arrow text columns.

A word is a maximal run of bytes other than ASCII white space (space, tab, LF, VT, FF, CR) in the UTF-8
text. Nothing here loops over words: a whole chunk of documents is one byte array, and the hash of every
word is a difference of two prefix sums.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
SHINGLE = 5
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _byte_codes(fold: bool) -> np.ndarray:
    """A random odd-free 64-bit code per byte; with ``fold`` A-Z share the codes of a-z."""
    codes = np.random.default_rng(20240).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U)
    if fold:
        codes[65:91] = codes[97:123]
    return codes


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CODES = {fold: _byte_codes(fold) for fold in (False, True)}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class _Powers:
    """Powers of the polynomial base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int):
        if len(self.up) < n:
            n = max(n, 2 * CHUNK_BYTES)
            up, down = np.full(n, _BASE, _U), np.full(n, _BASE_INVERSE, _U)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
        return self.up, self.down


_CACHE: dict[str, _Powers] = {}


def _powers(n: int):
    return _CACHE.setdefault("p", _Powers()).upto(n)


@dataclass
class Chunk:
    """Some consecutive rows: their words as byte spans, and where each row's words begin."""

    rows: slice
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # words of row i: bounds[i]:bounds[i + 1]

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def hashes(self, fold: bool) -> np.ndarray:
        """One mixed 64-bit hash per word."""
        if not len(self.starts):
            return np.empty(0, _U)
        up, down = _powers(len(self.data) + 1)
        total = np.empty(len(self.data) + 1, _U)
        total[0] = 0
        np.cumsum(_CODES[fold][self.data] * up[: len(self.data)], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts])


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Rows of a string column in chunks of about ``size`` bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        stop = min(stop, len(texts))
        part = data[offsets[at]: offsets[stop]]
        edges = offsets[at: stop + 1] - offsets[at]
        inside = ~_SPACE[part]
        before, after = np.empty(len(part) + 1, bool), np.empty(len(part) + 1, bool)
        before[0], before[1:] = False, inside
        after[-1], after[:-1] = False, inside
        before[edges] = False
        after[edges] = False
        starts = np.flatnonzero(inside & ~before[:-1])
        ends = np.flatnonzero(inside & ~after[1:]) + 1
        yield Chunk(slice(at, stop), part, starts, ends, np.searchsorted(starts, edges))
        at = stop


def spread_sum(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Order-sensitive combination of every run of ``width`` consecutive values."""
    if len(values) < width:
        return np.empty(0, _U)
    n, out, c = len(values) - width + 1, np.zeros(len(values) - width + 1, _U), 1
    for k in range(width):
        out += values[k: k + n] * _U(c)
        c = c * base % (1 << 64)
    return mix(out)


def shingle_sets(chunk: Chunk, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row: runs of ``width`` lower-cased words; a row with fewer
    words has its whole sequence as one; a row without words has none."""
    words = chunk.hashes(True)
    runs = spread_sum(words, width, 0xD6E8FEB86659FD93)
    out = []
    for a, b in zip(chunk.bounds[:-1], chunk.bounds[1:]):
        if b - a >= width:
            out.append(np.unique(runs[a: b - width + 1]))
        elif b > a:
            out.append(spread_sum(words[a:b], b - a, 0xD6E8FEB86659FD93 + 2 * int(b - a)))
        else:
            out.append(np.empty(0, _U))
    return out


def runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    """Order-sensitive hash of values[start:end] for many runs at once, by prefix sums."""
    up, down = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(mix(values ^ _U(salt)) * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` consecutive values, in log2(width) steps."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
