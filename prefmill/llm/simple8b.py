"""Simple-8b word-aligned coding of unsigned integers, vectorised over blocks.

A 64-bit word holds a 4-bit selector (high bits) and 60 bits of payload: COUNTS[s] values of BITS[s] bits each, the
first value lowest. Selectors 0 and 1 stand for 240 and 120 zeros. Values are cut into blocks of `block`; a block
begins on a word of its own (offsets say which) and its last word is padded with zeros. A value of 2^60 or more is an
escape: its slot holds 0, and (position, value) stands in the escape lists.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the published coding.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 1024


def encode(values: np.ndarray, block: int = BLOCK) -> dict:
    """words uint64, offsets uint32 (first word of each block), escape_at uint32, escapes uint64, n."""
    v = np.asarray(values, np.uint64)
    n, top = len(v), np.uint64(1) << np.uint64(60)
    at = np.flatnonzero(v >= top)
    escapes = v[at]
    if len(at):
        v = v.copy()
        v[at] = 0
    if int(v.max(initial=0)) < 1 << 32:
        v = v.astype(np.uint32)
    blocks = -(-n // block)
    wide = block + 240  # so that a word may read zeros beyond its block
    grid = np.zeros((blocks, wide), v.dtype)
    full = np.zeros(blocks * block, v.dtype)
    full[:n] = v
    grid[:, :block] = full.reshape(blocks, block)
    classes = np.unique(BITS)  # the narrowest class that holds the value
    tops = np.uint64(1) << classes.astype(np.uint64)
    if int(v.max(initial=0)) < 1 << 16:
        width = classes.astype(np.uint8)[np.searchsorted(tops, np.arange(1 << 16, dtype=np.uint64), side="right")][grid]
    else:
        width = classes.astype(np.uint8)[np.searchsorted(tops, grid.reshape(-1), side="right")].reshape(grid.shape)
    choice = np.full(grid.shape, 15, np.uint8)
    most, span = width, 1
    runs = {1: width}
    while span * 2 <= 240:  # maximum over the next 2, 4, 8 ... values
        nxt = most.copy()
        nxt[:, :-span] = np.maximum(most[:, :-span], most[:, span:])
        span *= 2
        runs[span] = most = nxt
        if span >= 8 and nxt[:, :block].min(initial=60) > 6:
            break  # no word of that many values or more
    for s in range(14, -1, -1):
        c, b = int(COUNTS[s]), int(BITS[s])
        p = 1 << (c.bit_length() - 1)
        if p not in runs:
            continue
        high = runs[p]
        if c > p:
            high = high.copy()
            high[:, : wide - (c - p)] = np.maximum(high[:, : wide - (c - p)], high[:, c - p :])
        choice[high <= b] = s
    rows = np.arange(blocks)
    pos = np.zeros(blocks, np.int64)
    ends = np.full(blocks, block)
    if blocks:
        ends[-1] = n - (blocks - 1) * block
    took_row, took_pos, took_sel = [], [], []
    live = rows
    while len(live):
        s = choice[live, pos[live]]
        took_row.append(live)
        took_pos.append(pos[live])
        took_sel.append(s)
        pos[live] += COUNTS[s]
        live = live[pos[live] < ends[live]]
    if not blocks:
        empty = np.zeros(0, np.uint64)
        return {"words": empty, "offsets": np.zeros(0, np.uint32), "escape_at": at.astype(np.uint32), "escapes": escapes, "n": 0}
    r, p, s = np.concatenate(took_row), np.concatenate(took_pos), np.concatenate(took_sel)
    order = np.argsort(r, kind="stable")
    r, p, s = r[order], p[order], s[order]
    words = s.astype(np.uint64) << np.uint64(60)
    for k in range(2, 16):
        pick = np.flatnonzero(s == k)
        if len(pick):
            part = grid[r[pick, None], p[pick, None] + np.arange(COUNTS[k])].astype(np.uint64)
            words[pick] |= np.bitwise_or.reduce(part << (np.arange(COUNTS[k]) * BITS[k]).astype(np.uint64), axis=1)
    offsets = np.searchsorted(r, rows).astype(np.uint32)
    return {"words": words, "offsets": offsets, "escape_at": at.astype(np.uint32), "escapes": escapes, "n": n}


def decode(words: np.ndarray, offsets: np.ndarray, escape_at, escapes, n: int, block: int = BLOCK) -> np.ndarray:
    """The values; blocks are independent, so any slice of words that begins at an offset decodes alone."""
    s = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[s]
    before = np.concatenate([[0], np.cumsum(counts)])
    row = np.searchsorted(offsets, np.arange(len(words)), side="right") - 1
    at = before[:-1] - before[offsets.astype(np.int64)][row] + row * block  # padding runs into the next block and is cut
    ends = np.minimum((row + 1) * block, n)
    out = np.zeros(n, np.uint64)
    for k in range(2, 16):
        pick = np.flatnonzero(s == k)
        if len(pick):
            b = np.uint64(BITS[k])
            part = (words[pick, None] >> (np.arange(COUNTS[k]) * BITS[k]).astype(np.uint64)) & ((np.uint64(1) << b) - np.uint64(1))
            to = at[pick, None] + np.arange(COUNTS[k])
            good = to < ends[pick, None]
            out[to[good]] = part[good]
    out[np.asarray(escape_at, np.int64)] = escapes
    return out
