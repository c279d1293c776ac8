"""Word shingles of whole texts as 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240601))
_BYTES = _rng.integers(0, 2**64, 256, dtype=_U)
_BASE = _U(0x9E3779B97F4A7C15)
_PLACES = _rng.integers(0, 2**64, 64, dtype=_U) | _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = _U(pow(int(_BASE), -1, 2**64))
    up = np.full(n, _BASE, _U)
    down = np.full(n, inverse, _U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes; a word is a run without ASCII white space."""
    solid = np.empty(len(data) + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(_SPACE[data], out=solid[1:-1])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return edges[0::2], edges[1::2]


#: Bytes hashed at once; the tables of powers are as long.
_SEGMENT = 1 << 20


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, A-Z taken as a-z if ``lower``; memory beyond the result is bounded."""
    out = np.empty(len(starts), _U)
    a = 0
    while a < len(starts):
        b = int(np.searchsorted(ends, starts[a] + _SEGMENT, side="right"))
        at = int(starts[a])
        if b > a:
            part = data[at : ends[b - 1]]
            out[a:b] = _segment_hashes(_LOWER[part] if lower else part, starts[a:b] - at, ends[a:b] - at)
            a = b
        else:  # a word longer than a segment
            word = data[at : ends[a]].tobytes()
            digest = hashlib.blake2b(word.lower() if lower else word, digest_size=8).digest()
            out[a] = int.from_bytes(digest, "little")
            a += 1
    return out


def _segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial in the word's bytes, made independent of its place."""
    up, down = _powers(_SEGMENT)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    A text of fewer words has one shingle, its whole sequence; one without
    words has none.
    """
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, ends = words(data)
    hashes = word_hashes(data, starts, ends)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    borders = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    n = len(hashes)
    full = np.zeros(max(n - width + 1, 0), _U)
    for k in range(width if len(full) else 0):
        full += hashes[k : n - width + 1 + k] * _PLACES[k]
    full = mix(full)
    out = []
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
        if b - a >= width:
            own = np.sort(full[a : b - width + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            short = (hashes[a:b] * _PLACES[: b - a]).sum(dtype=_U, keepdims=True) + _PLACES[32 + b - a]
            out.append(mix(short))
        else:
            out.append(np.empty(0, _U))
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union; empty sets link with nothing."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    both = overlap(a, b)
    return 100 * both >= percent * (small + large - both)


_FACTORS = _rng.integers(0, 2**64, 512, dtype=_U) | _U(1)
_OFFSETS = _rng.integers(0, 2**64, 512, dtype=_U)


def minima(sets: list[np.ndarray], permutations: int) -> np.ndarray:
    """One row of hash minima for each set; every set must be non-empty."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), permutations), _U)
    scratch = np.empty_like(flat)
    for k in range(permutations):
        np.bitwise_xor(flat, _OFFSETS[k], out=scratch)
        np.multiply(scratch, _FACTORS[k], out=scratch)
        out[:, k] = np.minimum.reduceat(scratch, at)
    return mix(out)
