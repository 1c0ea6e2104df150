"""Hierarchical index over fingerprints in Gray order, searched for all pairs within a distance.

Rows of one bucket are sorted by Gray rank, so that neighbours differ in few bits. Runs of rows form
nodes, runs of nodes form upper nodes. A node holds the bits that all its rows share; bits that an
upper node holds already are left out below it, so each shared bit is compared once on the way down.
A search adds up differences level by level and leaves a whole group when they pass the limit.
All buckets of a block of rows are searched at once with array operations.
"""

from __future__ import annotations

import numpy as np

FAN = 8
FRONTIER = 1_500_000


def gray_rank(words: np.ndarray) -> np.ndarray:
    """Position of each fingerprint (rows of big-endian 64-bit words) in Gray order, as words of the same shape."""
    rank = words.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    odd = np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        rank[:, k] ^= np.uint64(0) - odd
        odd = rank[:, k] & np.uint64(1)
    return rank


def gray_order(bucket: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Row order by bucket, then by Gray rank."""
    rank = gray_rank(words)
    return np.lexsort([*(rank[:, k] for k in reversed(range(rank.shape[1]))), bucket])


def _levels(starts: np.ndarray, words: np.ndarray) -> list[tuple]:
    """From the rows upwards: (first child, end child, last row, shared mask, pattern) of each level's nodes."""
    n = len(words)
    first, end, last = np.arange(n), np.arange(1, n + 1), np.arange(n)
    low = high = words
    levels = [(first, end, last, np.full_like(words, ~np.uint64(0)), words)]
    edge = starts
    while True:
        sizes = np.diff(np.append(edge, len(low)))
        inside = np.arange(len(low)) - np.repeat(edge, sizes)
        first = np.flatnonzero(inside % FAN == 0)
        end = np.append(first[1:], len(low))
        low, high = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
        last = last[end - 1]
        mask = ~(low ^ high)
        levels.append((first, end, last, mask, low & mask))
        if len(first) == len(edge):
            return levels
        edge = np.searchsorted(first, edge)


def linked_pairs(bucket: np.ndarray, words: np.ndarray, limit: int):
    """Yield arrays (i, j), i < j, of all rows of one bucket that differ in at most ``limit`` bits.

    ``bucket`` and ``words`` are in :func:`gray_order`. Each array pair holds a bounded number of rows.
    """
    n = len(words)
    if n < 2:
        return
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    sizes = np.diff(np.append(starts, n))
    root = np.repeat(np.arange(len(starts)), sizes)
    levels = _levels(starts, words)
    rest = []  # at each level, the bits that the parent doesn't hold
    for below, above in zip(levels, levels[1:], strict=False):
        parent = np.repeat(np.arange(len(above[0])), above[1] - above[0])
        rest.append(below[3] & ~above[3][parent])
    row_cost = np.repeat(sizes, sizes).cumsum()
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(row_cost, (row_cost[at - 1] if at else 0) + FRONTIER, "right")))
        query, node = np.arange(at, min(stop, n)), root[at : min(stop, n)]
        alone = sizes[node] > 1
        query, node = query[alone], node[alone]
        apart = np.zeros(len(query), np.int64)
        for depth in range(len(levels) - 1, 0, -1):
            first, end = levels[depth][0][node], levels[depth][1][node]
            width = end - first
            pick = np.repeat(np.arange(len(node)), width)
            child = np.arange(len(pick)) - np.repeat(np.cumsum(width) - width, width) + first[pick]
            query, apart = query[pick], apart[pick]
            ahead = levels[depth - 1][2][child] > query
            query, child, apart = query[ahead], child[ahead], apart[ahead]
            differ = (words[query] ^ levels[depth - 1][4][child]) & rest[depth - 1][child]
            apart = apart + np.bitwise_count(differ).sum(1, dtype=np.int64)
            near = apart <= limit
            query, node, apart = query[near], child[near], apart[near]
        if len(query):
            yield query, node
        at = stop


def least_labels(n: int, pairs) -> np.ndarray:
    """The least row that each of ``n`` rows reaches by the pairs."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            one, two = label[i], label[j]
            apart = one != two
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            one, two = one[apart], two[apart]
            np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
            while True:
                jumped = label[label]
                if (jumped == label).all():
                    break
                label = jumped
    return label
