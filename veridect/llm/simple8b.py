"""Simple-8b words: a selector of 4 bits says how many values of equal width share the other 60.

Values are coded in blocks of ``BLOCK``; blocks are independent and their word
offsets are kept, so all blocks are coded and decoded together by array
operations. A word at the end of a block may have room for more values than are
left; the reader cuts at the block's length. Values of more than 60 bits are
escapes: 0 in the words, (place, value) beside them.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
# How many values a word holds, and their bits, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


def _width(values: np.ndarray) -> np.ndarray:
    """Bits of each value, as uint8."""
    out = np.zeros(values.shape, dtype=np.uint8)
    rest = values
    while rest.any():
        out += rest > 0
        rest = rest >> np.uint64(1)
    return out


_SMALL = _width(np.arange(1 << 17, dtype=np.uint64))


def _selectors(width: np.ndarray) -> np.ndarray:
    """For each place of each block, the selector of the word that would start there."""
    best = np.full(width.shape, 15, dtype=np.uint8)
    # the widest value of the next n places, n growing along the table
    widest, n = width, 1
    for selector in range(14, -1, -1):
        count = int(COUNTS[selector])
        while n < count:
            step = min(n, count - n)
            ahead = np.zeros_like(widest)
            if step < width.shape[1]:
                ahead[:, :-step] = widest[:, step:]
            widest = np.maximum(widest, ahead)
            n += step
        best[widest <= BITS[selector]] = selector
    return best


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words, word offset of each block, escape places, escape values."""
    values = np.ascontiguousarray(values)
    places = np.flatnonzero(values >> np.uint8(60)) if values.dtype.itemsize > 4 else np.zeros(0, np.int64)
    escaped = values[places].astype(np.uint64)
    if len(places):
        values = values.copy()
        values[places] = 0
    parts = [_segment(values[start : start + SEGMENT]) for start in range(0, len(values), SEGMENT)]
    words = np.concatenate([np.zeros(0, np.uint64), *(p[0] for p in parts)])
    per_block = np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])
    return words, (np.cumsum(per_block) - per_block).astype(np.uint64), places.astype(np.uint64), escaped


#: Values coded at a time, so that the working arrays stay in the processor's cache.
SEGMENT = 256 * BLOCK
#: The most values in a word that has bits for them: so far may the last word of a block reach beyond it.
REACH = 60


def _segment(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """words, words per block."""
    n = len(values)
    blocks = -(-n // BLOCK)
    width = BLOCK + REACH
    padded = np.zeros((blocks, width), dtype=values.dtype)
    whole = n // BLOCK
    padded[:whole, :BLOCK] = values[: whole * BLOCK].reshape(whole, BLOCK)
    padded[whole:, : n - whole * BLOCK] = values[whole * BLOCK :]
    held = padded[:, :BLOCK]
    bits = _SMALL[held] if held.max() < len(_SMALL) else _width(held.astype(np.uint64))
    selector = np.zeros((blocks, width), dtype=np.uint8)
    selector[:, :BLOCK] = _selectors(bits)
    selector, padded = selector.ravel(), padded.ravel()
    # follow the words of all blocks in step
    at = np.arange(blocks) * width
    end = at + np.minimum(BLOCK, n - np.arange(blocks) * BLOCK)
    live, blocks_of, starts = np.arange(blocks), [], []
    while len(live):
        blocks_of.append(live)
        starts.append(at)
        at = at + COUNTS[selector[at]]
        more = at < end[live]
        live, at = live[more], at[more]
    start = np.sort(np.concatenate(starts))
    chosen = selector[start]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        if not BITS[s]:
            continue
        mine = np.flatnonzero(chosen == s)
        place = start[mine]
        packed = padded[place].astype(np.uint64)
        for k in range(1, int(COUNTS[s])):
            packed |= padded[place + k].astype(np.uint64) << np.uint64(k * int(BITS[s]))
        words[mine] |= packed
    return words, np.bincount(np.concatenate(blocks_of), minlength=blocks)


def decode(words: np.ndarray, offsets: np.ndarray, n: int, places: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    """The ``n`` values again; any range of blocks can be decoded by itself, given their offsets."""
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.uint8)
    counts = COUNTS[selector]
    per_block = np.diff(np.append(offsets.astype(np.int64), len(words)))
    before = np.cumsum(counts) - counts
    # each block has room for what its last word holds beyond it, so nothing needs to be cut while words are read
    width = BLOCK + REACH
    first = before[offsets.astype(np.int64)]
    start = before + np.repeat(np.arange(len(offsets)) * width - first, per_block)
    wide = np.zeros(len(offsets) * width, dtype=np.uint64)
    for s in np.unique(selector):
        if not BITS[s]:
            continue
        mine = np.flatnonzero(selector == s)
        rest, place = words[mine], start[mine]
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(int(COUNTS[s])):
            wide[place + k] = (rest >> np.uint64(k * int(BITS[s]))) & mask
    out = wide.reshape(-1, width)[:, :BLOCK].ravel()
    out[places.astype(np.int64)] = escaped
    return out[:n]
