"""Hashes of words and word shingles, many texts at a time in numpy.

A word's hash comes from running sums of byte values times powers of an odd base
modulo 2^64, so one pass over the bytes serves words of any length. Byte values
go through a fixed random table first and every hash through a finishing mix.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0xD6E8FEB86659FD93
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Powers:
    """Powers of BASE and of its inverse, grown when a longer buffer comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (self._row(b, size) for b in (BASE, pow(BASE, -1, 2**64)))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _row(b: int, size: int) -> np.ndarray:
        row = np.full(size, b, np.uint64)
        row[0] = 1
        return np.cumprod(row)


powers = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums S with S[j]-S[i] the sum of byte value times power over [i, j)."""
    up, _ = powers.of(max(1, len(data)))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes in each [start, end): equal contents have equal hashes wherever they stand."""
    _, down = powers.of(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _GOLD)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each word of a byte buffer."""
    edge = np.flatnonzero(np.diff(_SPACE[data], prepend=True, append=True))
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, lower: bool = True, piece: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of a byte buffer, worked through in pieces that end at white space."""
    if lower:
        data = _LOWER[data]
    start, end = word_bounds(data)
    out, first = [np.empty(0, np.uint64)], 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(end, start[first] + piece, "right")))
        at, to = start[first], end[last - 1]
        out.append(range_hash(prefix_sums(data[at:to]), start[first:last] - at, end[first:last] - at))
        first = last
    return np.concatenate(out), start


def combine(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k neighbouring words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out = mix(out * _GOLD) + words[j : j + n]
    return mix(out)


def _whole(words: np.ndarray) -> np.ndarray:
    """One hash for a sequence shorter than a shingle."""
    out = np.full(1, len(words), np.uint64)
    for w in words:
        out = mix(out * _GOLD) + w
    return mix(out ^ np.uint64(0x5851F42D4C957F2D))


def shingle_sets(texts: list[str | None], k: int, block: int = 1 << 20):
    """The sorted distinct shingle hashes of each text, in order."""
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and size < block:
            group.append((texts[at] or "").encode("utf-8", "surrogatepass"))
            size += len(group[-1]) + 1
            at += 1
        words, start = word_hashes(np.frombuffer(b"\n".join(group) + b"\n", np.uint8))
        ends = np.cumsum([len(g) + 1 for g in group])
        cut = np.searchsorted(start, ends)
        grams = combine(words, k)
        first = 0
        for last in cut.tolist():
            n = last - first
            if n >= k:
                yield np.unique(grams[first : last - k + 1])
            elif n:
                yield _whole(words[first:last])
            else:
                yield np.empty(0, np.uint64)
            first = last
