"""Minimal perfect hashing of whole numbers: distinct keys to the numbers below their count, without gaps.

Keys are hashed into a bit array somewhat longer than their count. Those alone at their bit keep it; the
others go on to a next, shorter array with another hash, until none is left. The number of a key is the rank
of its bit. Keys outside the set get some number or none, so users keep the keys by number and compare.
"""

from __future__ import annotations

import numpy as np

#: Bits per key of a level.
SPARSE = 1.5


def mixed(keys: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = mixed(np.array([level + 1], dtype=np.uint64))[0]
    return (mixed(keys ^ salt) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        taken = np.concatenate(levels) if levels else np.zeros(0, dtype=bool)
        self.rank = np.cumsum(taken) - taken
        self.starts = np.cumsum([0, *[len(bits) for bits in levels]])

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """The function of distinct ``keys``."""
        levels: list[np.ndarray] = []
        left = keys.astype(np.uint64)
        while len(left):
            size = max(8, int(SPARSE * len(left)))
            places = _places(left, len(levels), size)
            bits = np.bincount(places, minlength=size) == 1
            levels.append(bits)
            left = left[~bits[places]]
        return cls(levels)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of every key; -1 for some that are not in the set, any number for the rest of those."""
        keys = keys.astype(np.uint64)
        found = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            places = _places(keys[left], level, len(bits))
            hit = bits[places]
            found[left[hit]] = self.rank[self.starts[level] + places[hit]]
            left = left[~hit]
        return found

    def to_bytes(self) -> tuple[bytes, bytes]:
        sizes = np.array([len(bits) for bits in self.levels], dtype=np.int64)
        return sizes.tobytes(), b"".join([np.packbits(bits).tobytes() for bits in self.levels])

    @classmethod
    def from_bytes(cls, sizes: bytes, bits: bytes) -> PerfectHash:
        levels, at = [], 0
        packed = np.frombuffer(bits, dtype=np.uint8)
        for size in np.frombuffer(sizes, dtype=np.int64).tolist():
            end = at + -(-size // 8)
            levels.append(np.unpackbits(packed[at:end], count=size).astype(bool))
            at = end
        return cls(levels)
