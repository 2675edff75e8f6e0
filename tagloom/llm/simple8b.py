"""Simple-8b for token ids: a 4-bit selector and 60 bits of ids in every 64-bit word.

Ids of ``ESCAPE`` or more are written as ``ESCAPE`` and listed apart, so one wide id does not make its
neighbours wide. Every ``STRIDE`` words the number of ids before is stored, so any range of ids is decoded
from the nearest such word on, all words of one selector at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# fixed values of the format: bits of an id and ids of a word, by selector
WIDTH = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
COUNT = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])

ESCAPE = (1 << 15) - 1
STRIDE = 1024
BITS = np.array([n.bit_length() for n in range(ESCAPE + 1)], np.uint8)


@dataclass
class Block:
    n: int  # ids
    words: np.ndarray  # uint64
    wide: np.ndarray  # uint32, the escaped ids in order
    offsets: np.ndarray  # uint32, ids before every STRIDE-th word
    wide_before: np.ndarray  # uint32, escaped ids before every STRIDE-th word


def _steps(bits: np.ndarray) -> np.ndarray:
    """Selector that a word starting at each id takes: the first whose ids all fit. No id has over 15 bits."""
    chosen = np.full(len(bits), 12, np.uint8)  # four of 15 bits always fit
    widest = [bits]  # most bits of the 2^k ids from each on
    while 2 << len(widest) - 1 <= min(COUNT.max(), len(bits)):
        half = widest[-1]
        widest.append(np.maximum(half[:-(1 << len(widest) - 1)], half[1 << len(widest) - 1:]))
    for selector in range(11, -1, -1):
        n = int(COUNT[selector])
        if n > len(bits):
            break
        power = n.bit_length() - 1
        first, n_starts = widest[power], len(bits) - n + 1
        fits = np.maximum(first[:n_starts], first[n - (1 << power):n - (1 << power) + n_starts]) <= WIDTH[selector]
        chosen[:n_starts][fits] = selector
    return chosen


def encode(ids: np.ndarray) -> Block:
    ids = ids.astype(np.uint32, copy=False)
    escaped = ids >= ESCAPE
    small = np.concatenate([np.where(escaped, np.uint32(ESCAPE), ids), np.zeros(COUNT.max(), np.uint32)])
    chosen = _steps(BITS[small])
    step = COUNT[chosen].astype(np.uint8).tobytes()
    starts, i, n = [], 0, len(ids)
    add = starts.append
    while i < n:
        add(i)
        i += step[i]
    first = np.array(starts, np.int64)
    selectors = chosen[first]
    words = selectors.astype(np.uint64) << np.uint64(60)
    values = small.astype(np.uint64)
    for selector in np.unique(selectors).tolist():
        if WIDTH[selector]:
            at = np.flatnonzero(selectors == selector)
            lanes = np.arange(COUNT[selector])
            words[at] |= np.bitwise_or.reduce(
                values[first[at][:, None] + lanes] << (lanes * WIDTH[selector]).astype(np.uint64), axis=1)
    offsets = first[::STRIDE]
    before = np.concatenate([[0], np.cumsum(escaped)])[offsets]
    return Block(n, words, ids[escaped], offsets.astype(np.uint32), before.astype(np.uint32))


def decode(block: Block, start: int = 0, end: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``end`` (exclusive) as uint32."""
    end = block.n if end is None else min(end, block.n)
    if start >= end:
        return np.zeros(0, np.uint32)
    mark = int(np.searchsorted(block.offsets, start, "right")) - 1
    stop = int(np.searchsorted(block.offsets, end, "left"))
    words = block.words[mark * STRIDE:stop * STRIDE]
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNT[selectors]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]), np.uint32)
    for selector in np.unique(selectors).tolist():
        if WIDTH[selector]:
            at = np.flatnonzero(selectors == selector)
            lanes = np.arange(COUNT[selector])
            mask = np.uint64((1 << int(WIDTH[selector])) - 1)
            out[(ends - counts)[at][:, None] + lanes] = (
                words[at][:, None] >> (lanes * WIDTH[selector]).astype(np.uint64)) & mask
    base = int(block.offsets[mark])
    out = out[:min(len(out), block.n - base)]
    escaped = np.flatnonzero(out == ESCAPE)
    first = int(block.wide_before[mark])
    out[escaped] = block.wide[first:first + len(escaped)]
    return out[start - base:end - base]
