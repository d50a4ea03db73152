"""Vectorised word hashing: a slice of texts becomes numpy arrays of 64-bit word hashes.

The bytes of all texts of a slice are joined with line feeds.  A word's hash is a
polynomial over its bytes modulo 2**64, taken from one running sum over the slice, then
mixed with its length.  Cost is a few array passes per byte; there is no Python work per word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

SLICE_BYTES = 500_000
BLOCK_BYTES = 1_000_000  # of a long text hashed at a time
MULT = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def _inverse(x: int) -> int:
    return pow(x, -1, 2**64)


class _Powers:
    """Powers of an odd multiplier and of its inverse, grown when a longer text comes."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = -(-n // 65536) * 65536
            self.up = self._table(int(MULT), size)
            self.down = self._table(_inverse(int(MULT)), size)
        return self.up[:n], self.down[:n]

    @staticmethod
    def _table(base: int, size: int) -> np.ndarray:
        out = np.full(size, _U(base % 2**64), dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out, out=out)


_POWERS = _Powers()
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, size=256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(29))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table of separator bytes."""
    table = np.zeros(256, dtype=bool)
    for a, b in ranges:
        table[a:b + 1] = True
    return table


SPACES = separators((0x09, 0x0D), (0x20, 0x20))
NON_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


@dataclass
class Words:
    """Words of consecutive texts: hashes, byte bounds, and the first word of each text."""
    data: np.ndarray      # the joined bytes
    hashes: np.ndarray    # uint64 per word
    starts: np.ndarray    # byte positions in ``data``
    ends: np.ndarray
    first: np.ndarray     # index of each text's first word; one more than there are texts
    at: np.ndarray        # byte position of each text; one more than there are texts


def words_of(texts: Sequence[bytes], sep: np.ndarray, lower: bool = True) -> Words:
    """Words of a slice of texts (``lower``: A-Z lower-cased first)."""
    joined = b"\n".join([*texts, b""])
    if lower:
        joined = joined.lower()
    data = np.frombuffer(joined, dtype=np.uint8)
    n = len(data)
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    at[1:] = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
    inside = np.zeros(n + 2, dtype=np.int8)
    inside[1:-1] = ~sep[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    hashes = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):  # whole words of about a block of bytes at a time; a word's hash does not depend on its place
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + BLOCK_BYTES, "right")))
        s, e = starts[i:j] - base, ends[i:j] - base
        size = int(e[-1])
        up, down = _POWERS.get(size + 1)
        total = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data[base:base + size]] * up[:size], out=total[1:])
        hashes[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * MULT)
        i = j
    return Words(data, hashes, starts, ends, np.searchsorted(starts, at), at)


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the run of ``k`` words that starts at each word (as many as there are runs)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * _U(0x2545F4914F6CDD1D) + h[i:i + n]
    return mix(out)


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word span ``starts[i]:ends[i]``, independent of its place."""
    up, down = _POWERS.get(len(h) + 1)
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * up[:len(h)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * MULT)


def slices(texts: Sequence[bytes], limit: int = SLICE_BYTES) -> Iterator[slice]:
    """Consecutive slices of about ``limit`` bytes."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
