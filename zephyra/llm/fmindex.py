"""FM-index over a sequence of symbols, in numpy: suffix order, wavelet matrix, backward search and sampled positions.

All searches of a kind are made side by side: the arguments are arrays, one entry per pattern or row.
"""

from __future__ import annotations

import numpy as np

#: Every so many positions of the sequence keep their place in the suffix order.
SAMPLE = 8


def suffix_order(keys: np.ndarray) -> np.ndarray:
    """Suffix array by doubling. ``keys`` are non-negative; the end counts as smaller than everything."""
    n = len(keys)
    _, rank = np.unique(keys, return_inverse=True)
    rank, span = rank.astype(np.int64) + 1, 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - span] = rank[span:] if span < n else 0
        both = rank * (n + 2) + second
        order = np.argsort(both, kind="stable")
        ordered = both[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
        rank, span = new, 2 * span
        if span >= n or rank.max(initial=0) == n:
            return np.argsort(rank, kind="stable")


class Wavelet:
    """Wavelet matrix: one level of bits per binary digit of a symbol, with the ones before each place."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.digits = max(1, int(size - 1).bit_length())
        self.ones, self.zeros = [], []
        now = symbols.astype(np.int64)
        for d in reversed(range(self.digits)):
            bit = (now >> d) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(now) - int(bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low, high = np.zeros_like(place), place
        for d, ones, zeros in zip(reversed(range(self.digits)), self.ones, self.zeros, strict=True):
            bit = (symbol >> d) & 1
            low_ones, high_ones = ones[low], ones[high]
            low = np.where(bit == 1, zeros + low_ones, low - low_ones)
            high = np.where(bit == 1, zeros + high_ones, high - high_ones)
        return high - low

    def access(self, place: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(place)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[place + 1] - ones[place]
            symbol = (symbol << 1) | bit
            place = np.where(bit == 1, zeros + ones[place], place - ones[place])
        return symbol


class FMIndex:
    """Index of runs of symbols. ``symbols`` holds 1 and above inside runs and 0 after each run.

    For the order every 0 is a symbol of its own, so that the order is found after as many doublings as the longest run
    takes. The first place of each run is sampled, so no walk leaves its run.
    """

    def __init__(self, symbols: np.ndarray, size: int):
        self.symbols, self.size = symbols, size
        n = len(symbols)
        breaks = np.flatnonzero(symbols == 0)
        keys = symbols.astype(np.int64) + len(breaks)
        keys[breaks] = np.arange(len(breaks))
        order = suffix_order(keys)
        last = symbols[order - 1]  # the symbol before each suffix; before the first comes the break at the end
        self.tree = Wavelet(last, size)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])[:size]
        sampled = np.zeros(n, bool)
        sampled[::SAMPLE] = True
        sampled[0] = True
        sampled[breaks[:-1] + 1] = True
        self.kept = sampled[order]
        self.kept_before = np.cumsum(self.kept) - self.kept
        self.kept_at = order[self.kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffix order that start with each pattern: first and end. ``patterns``: one per row, equal lengths."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.symbols), np.int64)
        for k in reversed(range(patterns.shape[1])):
            symbol = patterns[:, k]
            low = self.before[symbol] + self.tree.rank(symbol, low)
            high = self.before[symbol] + self.tree.rank(symbol, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Place in the sequence of each row of the suffix order."""
        rows, steps, place = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        at = np.arange(len(rows))
        while len(at):
            done = self.kept[rows[at]]
            here = at[done]
            place[here] = self.kept_at[self.kept_before[rows[here]]] + steps[here]
            at = at[~done]
            symbol = self.tree.access(rows[at])
            rows[at] = self.before[symbol] + self.tree.rank(symbol, rows[at])
            steps[at] += 1
        return place
