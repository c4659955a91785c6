"""Word shingles of many texts at once as 64-bit hashes, with numpy over the bytes of an Arrow column.

Words are maximal runs of bytes other than space and \\t \\n \\v \\f \\r, with A-Z lower-cased. A word's hash is a
polynomial over its bytes modulo 2**64, taken from running sums, then mixed with its length; a shingle's hash
chains the hashes of its words. Two different shingles of one text share a hash with a chance near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose outputs look unrelated for related inputs."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


class _Powers:
    """Powers of the base and of its inverse, longer when a longer text comes."""

    size = 0

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > cls.size:
            cls.size = max(n, _CHUNK_BYTES)
            out = []
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                p = np.full(cls.size, base, dtype=_U)
                p[0] = 1
                out.append(np.multiply.accumulate(p))
            cls.powers, cls.inverses = out
        return cls.powers, cls.inverses


def _chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and row bounds of runs of rows of about `_CHUNK_BYTES`; a longer row comes alone."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _CHUNK_BYTES, side="right")) - 1)
        to = min(to, len(texts))
        bounds = offsets[at : to + 1]
        yield data[bounds[0] : bounds[-1]], bounds - bounds[0]
        at = to


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word."""
    n = len(data)
    if not n:
        return np.empty(0, _U), np.empty(0, np.int64)
    space = _SPACE[data]
    fresh = np.zeros(n, dtype=bool)
    fresh[bounds[:-1][bounds[:-1] < n]] = True
    before = np.concatenate(([True], space[:-1])) | fresh
    after = np.concatenate((space[1:] | fresh[1:], [True]))
    start, last = np.flatnonzero(~space & before), np.flatnonzero(~space & after)
    powers, inverses = _Powers.upto(n)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum(_VALUE[data] * powers[:n], out=sums[1:])
    hashed = (sums[last + 1] - sums[start]) * inverses[start]
    hashed = mix(hashed ^ ((last - start + 1).astype(_U) * _U(0xD6E8FEB86659FD93)))
    return hashed, np.searchsorted(bounds, start, side="right") - 1


def _chain(words: np.ndarray, firsts: np.ndarray, k: int) -> np.ndarray:
    acc = np.full(len(firsts), k * 0xA24BAED4963EE407 & (1 << 64) - 1, dtype=_U)
    for j in range(k):
        acc = mix(acc * _U(0x9FB21C651E98DF25) + words[firsts + j])
    return acc


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text, its distinct k-word shingles as ascending hashes.

    A text of fewer than k words, but not none, has one shingle: all its words. One without words has none.
    """
    for data, bounds in _chunks(texts):
        words, row = _words(data, bounds)
        rows = len(bounds) - 1
        counts = np.bincount(row, minlength=rows)
        firsts = np.concatenate(([0], np.cumsum(counts)))
        at = np.arange(max(0, len(words) - k + 1))
        at = at[row[: len(at)] == row[k - 1 : k - 1 + len(at)]]
        hashed = _chain(words, at, k)
        ends = np.concatenate(([0], np.cumsum(np.maximum(counts - k + 1, 0))))
        for r in range(rows):
            if counts[r] >= k:
                yield np.unique(hashed[ends[r] : ends[r + 1]])
            elif counts[r]:
                yield _chain(words, firsts[r : r + 1], int(counts[r]))
            else:
                yield np.empty(0, _U)
