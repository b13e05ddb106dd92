"""Words and word shingles of whole texts, hashed with numpy.

A word is a run of bytes other than the space and 0x09-0x0D, after lower-casing A-Z. Hashes have 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SLICE_BYTES = 1 << 20
SHINGLE_WORDS = 5

_rng = np.random.default_rng(20240131)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: The same with every ASCII byte that is no letter or digit, for words without punctuation.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = int(_rng.integers(1, 2**62)) * 2 + 1
_MULTIPLIERS = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse mod 2**64, n of each at least."""
    if len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """Words of a slice of texts; row: the text each word is in, first: each text's first word (one more at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> Words:
    """blank: which bytes part words."""
    data = LOWER[data]
    n = len(data)
    full = ~blank[data]
    begins, stops = full.copy(), full.copy()
    if n:
        inner = offsets[(offsets > 0) & (offsets < n)]
        after = full[:-1].copy()
        after[inner - 1] = False
        begins[1:] &= ~after
        before = full[1:].copy()
        before[inner - 1] = False
        stops[:-1] &= ~before
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    up, down = _tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, starts, ends, row, first, hashes)


def combine(parts: np.ndarray) -> np.ndarray:
    """Hashes of sequences of up to 64 hashes: the last axis is the sequence."""
    k = parts.shape[-1]
    return mix((parts * _MULTIPLIERS[:k]).sum(axis=-1, dtype=np.uint64) + np.uint64(k))


def shingle_sets(w: Words, size: int = SHINGLE_WORDS, rows: np.ndarray | slice = slice(None)) -> list[np.ndarray]:
    """Per text (of those in rows), the sorted distinct hashes of its shingles; a text of fewer words has its whole sequence as one, an empty text none."""
    n = len(w.hashes)
    if n >= size:
        total = w.hashes[: n - size + 1] * _MULTIPLIERS[0]
        for j in range(1, size):
            total = total + w.hashes[j : n - size + 1 + j] * _MULTIPLIERS[j]
        hashed = mix(total + np.uint64(size))
    else:
        hashed = np.empty(0, np.uint64)
    out = []
    for a, b in zip(w.first[:-1][rows].tolist(), w.first[1:][rows].tolist()):
        if b - a >= size:
            s = np.sort(hashed[a : b - size + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(combine(w.hashes[None, a:b]))
        else:
            out.append(np.empty(0, np.uint64))
    return out
