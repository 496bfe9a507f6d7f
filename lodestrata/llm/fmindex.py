"""A word-level FM-index in numpy: a Burrows-Wheeler transform over the words of
many short passages, held in a wavelet matrix of packed bits."""

from __future__ import annotations

import numpy as np


def _order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by the ``depth`` symbols that begin there (prefix doubling)."""
    rank, k = text.astype(np.int64), 1
    while True:
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -k)
        order = np.argsort(key, kind="stable")
        seen = key[order]
        fresh = np.concatenate([[0], np.cumsum(seen[1:] != seen[:-1])])
        rank = np.empty_like(fresh)
        rank[order] = fresh
        k *= 2
        if k >= depth or fresh[-1] == len(text) - 1:
            return order


class Bits:
    """Packed bits with the number of ones before each block of 64."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int32)
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


class FmIndex:
    """Backward search over passages given as one array of symbols from 1 on,
    with 0 after each; ``weights`` says how often each passage stands in the
    corpus. Patterns have ``depth`` symbols at most."""

    def __init__(self, text: np.ndarray, weights: np.ndarray, depth: int):
        self.n, sigma = len(text), int(text.max()) + 1
        order = _order(text, depth)
        owner = np.cumsum(text == 0) - (text == 0)
        self.weight = np.concatenate([[0], np.cumsum(weights[owner[order]])])
        seq = text[order - 1].astype(np.int64)
        below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))[:-1]])
        self.levels: list[tuple[int, Bits]] = []
        for bit in reversed(range(max(1, (sigma - 1).bit_length()))):
            ones = (seq >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(ones)))
            seq = np.concatenate([seq[~ones], seq[ones]])
        symbols = np.arange(sigma)
        self.shift = below - self._down(np.zeros(sigma, np.int64), symbols)

    def _down(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for bit, bits in self.levels:
            ones = bits.ones(at)
            at = np.where(symbol >> bit & 1, bits.zeros + ones, at - ones)
        return at

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals after one more symbol in front."""
        both = self._down(np.concatenate([low, high]), np.concatenate([symbol, symbol])) + np.concatenate([self.shift[symbol]] * 2)
        return both[: len(low)], both[len(low) :]

    def occurrences(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.weight[high] - self.weight[low]


def repeated_windows(index: FmIndex, text: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """For each passage text[first..last] the windows that stand in the corpus
    twice or more, as bits by where they start.

    Passages are streamed together, one step of all of them at a time. From an
    end the match grows to the left while it occurs twice; that longest match
    is the matching statistic of the end. A match of a window or more reports
    all windows inside it, and the next end is that of the first window that
    it leaves open.
    """
    found = np.zeros(len(first), np.int64)
    live = np.arange(len(first))
    end, at = last.astype(np.int64), last.astype(np.int64)
    low, high = np.zeros(len(first), np.int64), np.full(len(first), index.n)
    while len(live):
        lo, hi = index.extend(low[live], high[live], text[at[live]])
        grown = index.occurrences(lo, hi) >= 2
        low[live], high[live] = lo, hi
        at[live] -= grown
        stop = live[~grown | (at[live] < first[live])]  # at is the place that no longer matches
        if not len(stop):
            continue
        long = stop[end[stop] - at[stop] >= window]
        a, b = at[long] + 1 - first[long], end[long] - window + 1 - first[long]
        found[long] |= ((np.int64(1) << (b - a + 1)) - 1) << a
        end[stop] = np.minimum(end[stop] - 1, at[stop] + window - 1)
        at[stop], low[stop], high[stop] = end[stop], 0, index.n
        done = stop[end[stop] - first[stop] < window - 1]
        if len(done):
            live = np.setdiff1d(live, done, assume_unique=True)
    return found
