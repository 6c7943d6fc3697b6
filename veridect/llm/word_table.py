"""Ids of short words, looked up for all words of a batch at once.

A word of up to ``MOST`` bytes and its length fit two 64-bit numbers, which are
its key, so no two words share one. Keys lie in arrays with open addressing; the
ids of all words lie one after another in a pool.
"""

from __future__ import annotations

import numpy as np

MOST = 15
#: What a word takes off the end of the data it is read from, beyond its own bytes.
PAD = bytes(16)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_LENGTH = np.uint64(56)
# Odd multipliers of public 64-bit generators.
_SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def keys(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each word of at most ``MOST`` bytes; ``data`` goes on for ``PAD`` behind the last."""
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    low = eight[start] & _MASKS[np.minimum(length, 8)]
    high = eight[start + 8] & _MASKS[np.clip(length - 8, 0, 8)]
    return low, high | length.astype(np.uint64) << _LENGTH


def gathered(values: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` values from each ``begin`` on, one run after another."""
    before = np.cumsum(count) - count
    return values.take(np.repeat(begin - before, count) + np.arange(int(count.sum())), mode="clip")


class WordTable:
    """Outgrows ``limit`` bytes by what one batch brings; then ``settle`` forgets all words."""

    FIRST_SLOTS = 1 << 14

    def __init__(self, limit: int):
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self._make(self.FIRST_SLOTS)
        self.held = self.used = 0
        self.pool = np.zeros(self.FIRST_SLOTS, dtype="<u4")

    def settle(self) -> None:
        if self.low.nbytes + self.high.nbytes + self.value.nbytes + self.pool.nbytes > self.limit:
            self.forget()

    def _make(self, slots: int) -> None:
        self.low, self.high, self.value = (np.zeros(slots, dtype=np.uint64) for _ in range(3))

    def _home(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        spread = low * _SPREAD[0] ^ high * _SPREAD[1]
        spread ^= spread >> np.uint64(32)
        spread *= _SPREAD[2]
        return (spread >> np.uint64(65 - len(self.low).bit_length())).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """What the table holds of each word, 0 if nothing: see ``runs``."""
        at = self._home(low, high)
        held = self.high[at]
        found = (held == high) & (self.low[at] == low)
        left = np.flatnonzero(~found & (held != 0))
        while len(left):
            at[left] = slot = (at[left] + 1) & (len(self.low) - 1)
            held = self.high[slot]
            hit = (held == high[left]) & (self.low[slot] == low[left])
            found[left[hit]] = True
            left = left[~hit & (held != 0)]
        return np.where(found, self.value[at], np.uint64(0))

    def _place(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> None:
        at, left = self._home(low, high), np.arange(len(low))
        while len(left):
            slot = at[left]
            free = self.high[slot] == 0
            some, where = left[free], slot[free]
            self.value[where] = some  # of several words for one slot, one gets it
            won = self.value[where] == some.astype(np.uint64)
            some, where = some[won], where[won]
            self.low[where], self.high[where], self.value[where] = low[some], high[some], value[some]
            free[free] = won
            left = left[~free]
            at[left] = (at[left] + 1) & (len(self.low) - 1)

    def add(self, low: np.ndarray, high: np.ndarray, begin: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """Different words that the table does not hold, each with ``count`` of the ``ids`` from ``begin`` on."""
        slots = len(self.low)
        while self.held + len(low) > slots * 0.6:
            slots *= 2
        if slots > len(self.low):
            old = np.flatnonzero(self.high)
            old = self.low[old], self.high[old], self.value[old]
            self._make(slots)
            self._place(*old)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, max(len(self.pool) * 3 // 2, self.used + len(ids)))
        self.pool[self.used : self.used + len(ids)] = ids
        self._place(low, high, (begin + self.used).astype(np.uint64) << np.uint64(8) | count.astype(np.uint64))
        self.used += len(ids)
        self.held += len(low)

    @staticmethod
    def runs(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool the ids of each word begin, and how many they are."""
        return (value >> np.uint64(8)).astype(np.int64), (value & np.uint64(255)).astype(np.int64)
