"""Byte-pair merging of one piece, for any vocabulary."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from heapq import heapify, heappop, heappush


SHORT = 48  # up to here a plain search for the lowest rank beats the heap
NONE = 1 << 60


def merged_short(symbols: Sequence, rank: Callable) -> list:
    held = list(symbols)
    ranks = [NONE if (r := rank(a, b)) is None else r for a, b in zip(held, held[1:])]
    while ranks:
        low = min(ranks)
        if low == NONE:
            break
        i = ranks.index(low)
        held[i] += held.pop(i + 1)
        del ranks[i]
        if i:
            r = rank(held[i - 1], held[i])
            ranks[i - 1] = NONE if r is None else r
        if i < len(ranks):
            r = rank(held[i], held[i + 1])
            ranks[i] = NONE if r is None else r
    return held


def merged(symbols: Sequence, rank: Callable) -> list:
    """``symbols`` after merging neighbours, lowest rank first, then leftmost.

    ``rank(a, b)`` is the rank of joining two neighbours or None.  A heap and a
    linked list make this n log n, so a piece may be a whole long text."""
    n = len(symbols)
    if n <= SHORT:
        return merged_short(symbols, rank)
    held = list(symbols)  # None where a symbol was merged into its left neighbour
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        r = rank(held[i], held[i + 1])
        if r is not None:
            heap.append((r, i, i + 1, 0, 0))
    heapify(heap)
    version = [0] * n  # grows as a symbol grows; entries of older symbols are stale
    while heap:
        _, i, j, *seen = heappop(heap)
        if held[i] is None or after[i] != j or seen != [version[i], version[j]]:
            continue
        held[i] = held[i] + held[j]
        held[j] = None
        version[i] += 1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n:
                r = rank(held[a], held[b])
                if r is not None:
                    heappush(heap, (r, a, b, version[a], version[b]))
    return [s for s in held if s is not None]
