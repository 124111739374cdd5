"""64-bit names of words and word sequences, a batch at a time."""

from __future__ import annotations

import numpy as np

STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(3).integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.multiply.accumulate(np.full(1 << 12, STEP))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(length: int) -> np.ndarray:
    global _POWERS
    if length > len(_POWERS):
        _POWERS = np.multiply.accumulate(np.full(1 << length.bit_length(), STEP))
    return _POWERS


def segments(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true entries."""
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return edges[::2], edges[1::2]


def segment_hashes(raw: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each of the runs of bytes that ``segments`` found."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    letters = raw[inside]
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    sums = np.add.reduceat(_BYTE[letters] * _powers(int(lengths.max()))[place], first)
    return mix(sums + lengths.astype(np.uint64))


def follow(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The name of a sequence from the names of its first part and of what follows."""
    return mix(left * STEP + right)
