"""A table of positions of 64-bit keys in numpy."""

from __future__ import annotations

import numpy as np


class Lookup:
    """Positions of known 64-bit keys, by a few direct-mapped tables on different bits of the key.

    Broadcasts hold `state`, as they are pickled by reference and executors need not know this class.
    """

    def __init__(self, keys: np.ndarray):
        self.keys, self.tables = keys, []
        bits, left = max(10, int(len(keys)).bit_length() + 2), np.arange(len(keys))
        while len(left):
            shift = np.uint64(64 - bits - 7 * len(self.tables))
            slot = (keys[left] >> shift & np.uint64((1 << bits) - 1)).astype(np.int64)
            table = np.full(1 << bits, -1, np.int32)
            table[slot] = left
            self.tables.append((shift, np.uint64((1 << bits) - 1), table))
            left = left[table[slot] != left]
            if len(self.tables) == 5 and len(left):
                raise ValueError("keys are not distinct hashes")

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, -1 for unknown ones."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        left = np.arange(len(keys))
        for shift, mask, table in self.tables:
            found = table[(keys[left] >> shift & mask).astype(np.int64)]
            taken = np.flatnonzero(found >= 0)  # a key that is not in this table nor in a later one most often meets a free slot
            left, found = left[taken], found[taken]
            good = self.keys[found] == keys[left]
            out[left[good]] = found[good]
            left = left[~good]
        return out

    @property
    def state(self) -> tuple:
        return self.keys, self.tables

    @classmethod
    def of(cls, keys: np.ndarray, tables: list) -> Lookup:
        out = cls.__new__(cls)
        out.keys, out.tables = keys, tables
        return out


def opened(shared) -> Lookup:
    """The table of a broadcast state."""
    return Lookup.of(*shared.value)
