"""Array hashing of many texts at once, for use inside tasks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of the public splitmix64 generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


#: The longest powers asked for so far, by direction; shorter ones are their beginning.
_POWERS: dict[bool, np.ndarray] = {}


def _powers(size: int, inverse: bool) -> np.ndarray:
    if inverse not in _POWERS or len(_POWERS[inverse]) < size:
        out = np.full(size, _INVERSE if inverse else BASE, dtype=np.uint64)
        out[0] = 1
        _POWERS[inverse] = np.multiply.accumulate(out, out=out)
    return _POWERS[inverse]


class ByteHashes:
    """Hashes of any byte ranges of one buffer, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        """With ``lower``, A-Z count as lower case."""
        size = 1 << max(16, int(len(data)).bit_length())
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        values = _byte_values()[_LOWER] if lower else _byte_values()
        weighted = values[data]
        weighted *= _powers(size, False)[: len(data)]
        np.cumsum(weighted, out=self.sums[1:])
        self.shift = _powers(size, True)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return mix((self.sums[end] - self.sums[start]) * self.shift[start] + length * np.uint64(BASE))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each word between white space, A-Z in lower case, in order."""
    data = np.frombuffer(b" " + b" ".join(t or b"" for t in texts) + b" ", dtype=np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    first = np.cumsum([1] + [len(t or b"") + 1 for t in texts[:-1]]) if texts else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(first)), np.diff(np.searchsorted(start, first), append=len(start)))
    return owner, ByteHashes(data, lower=True).ranges(start, end)


def shingles(owner: np.ndarray, word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each run of ``size`` words; a text with fewer words gives one run of all of them."""
    n = len(word)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    count = np.diff(np.append(first, n))
    place = np.arange(n) - np.repeat(first, count)
    left = np.repeat(count, count) - place
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        have = left > k
        at = np.flatnonzero(have) + k
        out[have] += word[at] * np.uint64(pow(BASE, k, 2**64))
    keep = (left >= size) | (place == 0)
    return owner[keep], mix(out[keep])
