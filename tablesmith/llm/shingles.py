"""Hashed word shingles of many texts at once, in numpy."""

from functools import cache

import numpy as np

# Words are runs of bytes other than these; A-Z count as a-z.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


@cache
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for 2**bits places."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.ones(1, np.uint64)
        for i in range(bits):
            p = np.concatenate([p, p * np.uint64(pow(base, 2**i, 2**64))])
        out.append(p)
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: list[str | bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and where the words of each text start (one more at the end)."""
    raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    first = np.cumsum([0, *(len(r) + 1 for r in raw)])
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(raw) + 1, np.int64)
    data = _LOWER[data]
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(int(len(data)).bit_length())
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)
    return hashes, np.searchsorted(starts, first)


def shingles(texts: list[str | bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of ``size`` words in order, and where those of each text start.

    A text with fewer words has its whole sequence as one shingle, one without words has none.
    """
    words, first = word_hashes(texts)
    counts = np.diff(first)
    full = np.maximum(counts - size + 1, 0)
    short = (counts > 0) & (counts < size)
    offsets = np.concatenate([[0], np.cumsum(full + short)])
    out = np.zeros(offsets[-1], np.uint64)
    if len(words) >= size:
        rolled = np.zeros(len(words) - size + 1, np.uint64)
        for i in range(size):
            rolled = rolled * _STEP + words[i : len(words) - size + 1 + i]
        within = np.repeat(first[:-1] - offsets[:-1], full + short) + np.arange(offsets[-1])
        usable = np.repeat(~short, full + short)
        out[usable] = mix(rolled[within[usable]])
    for i in np.flatnonzero(short):
        h = 0
        for w in words[first[i] : first[i + 1]].tolist():
            h = (h * int(_STEP) + w) % 2**64
        out[offsets[i]] = mix(np.array([(h ^ (int(counts[i]) * _BASE)) % 2**64], np.uint64))[0]
    return out, offsets


def sets(texts: list[str | bytes], size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    hashes, offsets = shingles(texts, size)
    return [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
