"""Burrows-Wheeler transforms of shards of strings, and their merge by iterative interleave refinement.

Each shard is sorted by itself. The merge never compares suffixes again: an interleave of the shards, sorted by the first h
symbols, is refined to h + 1 symbols by dealing each position to the place of the suffix one symbol longer, in order of that
symbol. The round in which neighbours part is their longest common prefix."""

from __future__ import annotations

import numpy as np

#: Bytes in a shard.
SHARD = 1 << 16
#: Symbols of nine bits in the first key of a sort.
PACKED = 7


def suffix_array(symbols: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes by their first `depth` symbols at least; ends are the positions of the strings' terminators,
    each of which is a symbol of its own."""
    n = len(symbols)
    # the first PACKED symbols at once; a terminator is above all bytes, and what follows it does not count
    ended, key, h = np.zeros(n, bool), np.zeros(n, np.int64), PACKED
    stop = np.zeros(n, bool)
    stop[ends] = True
    for k in range(h):
        key <<= 9
        rest = max(n - k, 0)
        key[:rest] += np.where(ended[:rest], 0, symbols[k:])
        ended[:rest] |= stop[k:]
    order = np.argsort(key, kind="stable")  # equal ones with terminators stay in the order of these
    while True:
        sorted_ = key[order]
        fresh = sorted_[1:] != sorted_[:-1]
        if h == PACKED:
            fresh |= ended[order[1:]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([1], fresh.astype(np.int64))))
        if h >= depth or rank[order[-1]] == n:
            return order
        key = rank * (n + 2)
        key[: max(n - h, 0)] += rank[h:]
        order = np.argsort(key)  # equal ones share more than any later step asks for, or are told apart in the next round
        h *= 2


def transform(symbols: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, BWT and LF of a shard: LF leads from a suffix to the suffix one symbol longer, -1 from a whole string."""
    order = suffix_array(symbols, ends, depth)
    last = np.zeros(len(symbols), bool)
    last[ends] = True
    starts = np.concatenate(([0], ends[:-1] + 1))
    whole = np.zeros(len(symbols), bool)
    whole[starts] = True
    before = symbols[order - 1]
    lf = np.full(len(order), -1, np.int64)
    use = np.flatnonzero(~whole[order])
    # the i-th suffix that a symbol precedes is the i-th that begins with it; terminators are never dealt to
    begins = np.flatnonzero(~last[order])
    by = symbols[order[begins]]
    to = begins[np.argsort(by, kind="stable")]
    back = use[np.argsort(before[use], kind="stable")]
    lf[back] = to
    return order, before, lf


def repeats(strings: list[tuple[np.ndarray, np.ndarray]], depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Merge shards (symbols, ends) of strings; gives, for the suffixes that share their first `depth` symbols with another
    one, the places as (shard, position) and, for each, the number of its interval of common prefixes.

    Suffixes whose interval holds no other are settled and leave the interleave: no longer one can need them."""
    parts = [transform(s, e, depth) for s, e in strings]
    base = np.concatenate(([0], np.cumsum([len(p[0]) for p in parts])))
    bwt = np.concatenate([p[1] for p in parts]).astype(np.uint16, copy=False)
    lf = np.concatenate([np.where(p[2] >= 0, p[2] + b, -1) for p, b in zip(parts, base, strict=False)])
    # a step of two symbols: none of them is a terminator, so both are two bytes, which sort by their digits
    far = np.where(lf >= 0, lf[lf], -1)
    steps = {1: (bwt.astype(np.uint8), lf.astype(np.int32)), 2: ((bwt[lf] << 8 | bwt & 255).astype(np.uint16), far.astype(np.int32))}
    # h = 0: all in one interval, shard by shard; a whole string has nothing longer to deal to
    now = np.arange(base[-1], dtype=np.int32)
    interval = np.zeros(len(now), np.int32)
    for size in [1] * (depth % 2) + [2] * (depth // 2):
        symbols, longer = steps[size]
        live = longer[now] >= 0
        now, interval = now[live], interval[live]
        if not len(now):
            break
        symbol = symbols[now]
        order = np.argsort(symbol, kind="stable")
        symbol, group = symbol[order], interval[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (symbol[1:] != symbol[:-1]) | (group[1:] != group[:-1])
        # whoever is neither like the one before nor like the next is alone
        keep = ~fresh
        keep[:-1] |= ~fresh[1:]
        now = longer[now[order[keep]]]
        interval = np.cumsum(fresh[keep], dtype=np.int32)
    shard = np.searchsorted(base, now, "right") - 1
    sa = np.concatenate([p[0] for p in parts])
    return [shard, sa[now]] if len(now) else [np.zeros(0, np.int64)] * 2, interval
