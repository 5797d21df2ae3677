"""A minimal perfect hash over 64-bit keys, as flat numpy arrays."""

from __future__ import annotations

import numpy as np

#: Slots for each key that a level still has to place. More slots: fewer levels, more memory.
ROOM = 2.0
MAX_LEVELS = 48


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """Scramble 64-bit keys so that each seed gives an unrelated order (multiply and shift)."""
    with np.errstate(over="ignore"):
        x = keys ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Maps each of n distinct keys to its own number in 0..n-1; any other key to some number or to -1.

    Each level is a bit array: a key that is alone in its slot is placed there, the others go to the
    next level. A key's number is the count of set bits before its own.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])[:-1]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts, left = [], [], np.asarray(keys, np.uint64)
        while left.size:
            if len(sizes) == MAX_LEVELS:
                raise ValueError("keys of a perfect hash must be distinct")
            size = -(-max(64, int(left.size * ROOM)) // 64) * 64
            slot = (mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(slot, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[slot]]
        return cls(np.array(sizes, np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint64))

    def find(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, np.uint64)
        out, open_, base = np.full(keys.size, -1, np.int64), np.arange(keys.size), 0
        for level, size in enumerate(self.sizes):
            at = (mix(keys[open_], level) % np.uint64(size)).astype(np.int64) + base
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = self.before[at[hit] >> 6] + below[hit]
            open_, base = open_[~hit], base + int(size)
            if not open_.size:
                break
        return out
