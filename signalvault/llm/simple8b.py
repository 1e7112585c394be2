"""Simple-8b: ids packed in 64-bit words, a 4-bit selector and 60 bits of equal-width values each.

Ids lie in blocks of BLOCK; each block begins at a word of its own, whose place is kept, so blocks are packed and
unpacked independently: all blocks of an array advance side by side, one word a step. A value of 61 bits or more is
escaped: a word of selector ESCAPE, then the value itself.
"""

from __future__ import annotations

import numpy as np

BLOCK = 512
ESCAPE = 0
# Fixed values of the coding: values a word holds and their bits, by selector 1 to 14 (0 escapes).
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words of ``values`` (unsigned) and the first word of every block."""
    n = len(values)
    values = values.astype(np.uint64)
    blocks = -(-n // block)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = block + int(COUNTS.max())  # zeros behind each block stand for values past its end
    table = np.zeros((blocks, row), np.uint64)
    full = n // block
    table[:full, :block] = values[:full * block].reshape(full, block)
    table[full:, :n - full * block] = values[full * block:]
    values = table.ravel()
    if int(values.max()) < 1 << 24:
        width = np.frexp(values.astype(np.float32))[1].astype(np.uint8)
    else:
        low, high = (values & np.uint64(0xFFFFFFFF)).astype(np.float64), (values >> np.uint64(32)).astype(np.float64)
        width = np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.uint8)
    widest, reach = {1: width}, 1
    while reach < COUNTS.max():
        last = widest[reach]
        widest[2 * reach] = last.copy()
        np.maximum(last[:-reach], last[reach:], out=widest[2 * reach][:-reach])
        reach *= 2
    selector = np.zeros(len(values), np.int8)
    for s in range(len(COUNTS) - 1, 0, -1):
        count, half = int(COUNTS[s]), 1 << (int(COUNTS[s]).bit_length() - 1)
        over = widest[half].copy()
        if count > half:
            shift = count - half
            np.maximum(over[:-shift], widest[half][shift:], out=over[:-shift])
        selector[over <= BITS[s]] = s
    at = np.arange(blocks) * row
    end = at + np.minimum(block, n - np.arange(blocks) * block)
    owner = np.arange(blocks)
    steps = []
    while len(at):
        steps.append((owner, at))
        at = at + COUNTS[selector[at]]
        more = at < end
        owner, at, end = owner[more], at[more], end[more]
    owner, at = np.concatenate([o for o, _ in steps]), np.concatenate([a for _, a in steps])
    order = np.argsort(at)
    owner, at = owner[order], at[order]
    chosen = selector[at]
    words = np.zeros(len(at), np.uint64)
    for s in np.unique(chosen).tolist():
        mine = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            continue
        start, word = at[mine], np.full(len(mine), s << 60, np.uint64)
        for j in range(int(COUNTS[s])):
            word |= values[start + j] << np.uint64(j * int(BITS[s]))
        words[mine] = word
    escaped = np.flatnonzero(chosen == ESCAPE)
    if len(escaped):
        words = np.insert(words, escaped + 1, values[at[escaped]])
        owner = np.insert(owner, escaped + 1, owner[escaped])
    return words, np.searchsorted(owner, np.arange(blocks))


def unpack(words: np.ndarray, starts: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` values of ``words``; ``starts`` has the first word of every block."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == ESCAPE).tolist():
        if not raw[i]:
            raw[i + 1] = True
    count = np.where(raw, 0, COUNTS[np.where(raw, ESCAPE, selector)])
    owner = np.zeros(len(words), np.int64)
    owner[starts[1:]] = 1
    owner = np.cumsum(owner)
    before = np.cumsum(count) - count
    place = before - before[starts][owner] + owner * block
    stop = np.minimum((owner + 1) * block, n)
    out = np.zeros(n, np.uint64)
    for s in np.unique(selector[~raw]).tolist():
        mine = np.flatnonzero((selector == s) & ~raw)
        if s == ESCAPE:
            out[place[mine]] = words[mine + 1]
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for j in range(int(COUNTS[s])):
            there = mine[place[mine] + j < stop[mine]]
            out[place[there] + j] = (words[there] >> np.uint64(j * int(BITS[s]))) & mask
    return out
