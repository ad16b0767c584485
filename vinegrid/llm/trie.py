"""Self-join of a binary trie of 64-bit values within a Hamming budget."""

from __future__ import annotations

import numpy as np


def trie_pairs(v: np.ndarray, a: np.ndarray, b: np.ndarray, bit: np.ndarray, spent: np.ndarray, budget: int, count: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the budget below pairs of trie nodes.

    v: values (uint64), sorted below each node. a, b: k x 2 ranges of v, the nodes of each pair; equal ranges mean a node with
    itself. bit: the nodes' depth, spent: differing bits above it. All node pairs go down together, level by level: each pair
    becomes the pairs of its children, unlike children cost a bit, pairs beyond the budget or without rows are dropped. Where
    both nodes hold one row each, what is left of the path is one edge, whose differing bits are added at once; rows of equal
    value meet at the last level. count: gets the node pairs of each level and how many of their children the budget drops.
    """
    found_i, found_j = [], []
    while len(a):
        same = (a == b).all(axis=1)
        size_a, size_b = a[:, 1] - a[:, 0], b[:, 1] - b[:, 0]
        leaf = (size_a == 1) & (size_b == 1) | (bit >= 64)
        if leaf.any():
            n = (size_a * size_b)[leaf]
            at = np.repeat(np.flatnonzero(leaf), n)
            k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            i, j = a[at, 0] + k // size_b[at], b[at, 0] + k % size_b[at]
            two = ~same[at] | (i < j)
            at, i, j = at[two], i[two], j[two]
            depth = bit[at].astype(np.uint64)
            below = np.where(depth < 64, ~np.uint64(0) >> np.minimum(depth, np.uint64(63)), np.uint64(0))
            near = spent[at] + np.bitwise_count((v[i] ^ v[j]) & below) <= budget
            found_i.append(i[near]), found_j.append(j[near])
            go = ~leaf
            a, b, bit, spent, same = a[go], b[go], bit[go], spent[go], same[go]
            if not len(a):
                break
        shift = (63 - bit).astype(np.uint64)

        def middle(node: np.ndarray) -> np.ndarray:
            """The first place in each node's range whose next bit is set."""
            low, high = node[:, 0].copy(), node[:, 1].copy()
            while (open_ := low < high).any():
                mid = (low + high) // 2
                one = (v[np.minimum(mid, len(v) - 1)] >> shift) & np.uint64(1) == 1
                high = np.where(open_ & one, mid, high)
                low = np.where(open_ & ~one, mid + 1, low)
            return low

        mid_a, mid_b = middle(a), middle(b)
        a0, a1 = np.stack([a[:, 0], mid_a], 1), np.stack([mid_a, a[:, 1]], 1)
        b0, b1 = np.stack([b[:, 0], mid_b], 1), np.stack([mid_b, b[:, 1]], 1)
        cross = ~same  # a node with itself needs its unlike children once only
        a, b = np.concatenate([a0, a1, a0, a1[cross]]), np.concatenate([b0, b1, b1, b0[cross]])
        spent = np.concatenate([spent, spent, spent + 1, spent[cross] + 1])
        bit = np.concatenate([bit, bit, bit, bit[cross]]) + 1
        filled = (a[:, 0] < a[:, 1]) & (b[:, 0] < b[:, 1])
        keep = (spent <= budget) & filled
        if count is not None:
            count += [len(mid_a), int((filled & ~keep).sum())]
        a, b, bit, spent = a[keep], b[keep], bit[keep], spent[keep]
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.zeros(0, np.int64), np.zeros(0, np.int64))
