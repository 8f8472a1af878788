"""An open-addressed table from 64-bit keys to small numbers, filled and read with whole arrays."""

from __future__ import annotations

import numpy as np

from zephyra.llm.texts import mixed


class Lookup:
    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length() + 1)
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        keys, slot = keys.astype(np.uint64), self._slot(keys.astype(np.uint64))
        values = values.astype(np.int32)
        while len(keys):
            free = np.flatnonzero(self.values[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 for a key that is not there."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int32)
        at, slot = np.arange(len(keys)), self._slot(keys)
        while len(at):
            value = self.values[slot]
            hit = (self.keys[slot] == keys[at]) & (value >= 0)
            out[at[hit]] = value[hit]
            more = ~hit & (value >= 0)
            at, slot = at[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return out
