"""Word shingles as 64-bit numbers, computed for many texts at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
CHUNK_BYTES = 1 << 20
#: Of texts whose sets are computed at once; some thirty times as much is held meanwhile.
SET_BYTES = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


LETTERS = mixed(np.arange(1, 257, dtype=U) * BASE)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the power of 0 .. n - 1, and their inverses modulo 2**64."""
    inverse = pow(int(BASE), -1, 1 << 64)
    up, down = np.full(n, BASE, U), np.full(n, inverse, U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), ends


def shingle_sets(texts: pa.Array, words: int = 3) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of so many words, ascending. A-Z
    count as a-z, words are runs of ``[^\\x20\\x09-\\x0D]``; a text of fewer
    words is one shingle, one without words none."""
    data, ends = _bytes(texts)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + SET_BYTES, "right")) - 1)
        stop = min(stop, len(texts))
        yield from _chunk(data[ends[at] : ends[stop]], ends[at : stop + 1] - ends[at], words)
        at = stop


def _chunk(data: np.ndarray, ends: np.ndarray, words: int) -> Iterator[np.ndarray]:
    empty = np.zeros(0, U)
    if not len(data):
        yield from (empty for _ in range(len(ends) - 1))
        return
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, bool)  # where a text begins
    edge[ends] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    up, down = _powers(1 << max(18, int(len(data)).bit_length()))
    total = np.concatenate([np.zeros(1, U), np.cumsum(LETTERS[data] * up[: len(data)], dtype=U)])
    word = mixed((total[end] - total[start]) * down[start])
    first = np.searchsorted(start, ends)  # of each text's words
    if len(word) >= words:
        shingle = np.zeros(len(word) - words + 1, U)
        for k in range(words):
            shingle = shingle * BASE + word[k : len(word) - words + 1 + k]
        shingle = mixed(shingle)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            one = np.sort(shingle[a : b - words + 1])
            yield one[np.concatenate([[True], one[1:] != one[:-1]])] if len(one) > 1 else one
        elif b > a:
            short = np.full(1, U(b - a))
            for k in range(a, b):
                short = short * BASE + word[k : k + 1]
            yield mixed(short)
        else:
            yield empty
