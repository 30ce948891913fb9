"""An open-addressing table over distinct 64-bit hashes, built and asked in numpy."""

from __future__ import annotations

import numpy as np


class Lookup:
    """Index of each of ``keys`` (distinct, well mixed); a key that is 0 is never found."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = int(1.5 * len(keys) + 1).bit_length()  # filled to at most two thirds
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.key, self.slot = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left, place = np.arange(len(keys)), (keys >> self.shift).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.key[place] == 0)
            spot, first = np.unique(place[free], return_index=True)
            put = free[first]
            self.key[spot], self.slot[spot] = keys[left[put]], left[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, place = left[rest], (place[rest] + 1) & self.mask

    def find(self, key: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where it isn't held."""
        return self.values(key, self.slot)

    def values(self, key: np.ndarray, held: np.ndarray) -> np.ndarray:
        """What ``held``, aligned with the table's places, has for each key; for one that isn't held, its value at a free place."""
        place = (key >> self.shift).astype(np.int64)
        met = self.key[place]
        out = held[place]
        todo = np.flatnonzero(met != key)
        todo = todo[met[todo] != 0]
        while len(todo):
            place[todo] = (place[todo] + 1) & self.mask
            met = self.key[place[todo]]
            out[todo] = held[place[todo]]
            todo = todo[(met != key[todo]) & (met != 0)]
        return out
