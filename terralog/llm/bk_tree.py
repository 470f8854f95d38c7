"""BK-trees over 64-bit fingerprints, built and searched level by level with arrays.

Many small trees share one set of arrays: each bucket of a shard is a tree, its first member the root. A child hangs from its parent under their
integer Hamming distance; a search with radius r at distance d follows only edges from d - r to d + r.
"""

from __future__ import annotations

import numpy as np

SLICE = 512                       # queries that advance together


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """Trees over ``prints``; ``bucket`` says which tree a print belongs to."""

    def __init__(self, prints: np.ndarray, bucket: np.ndarray):
        self.prints = prints
        _, first, which = np.unique(bucket, return_index=True, return_inverse=True)
        self.root = first[which]
        parent = self.root.copy()
        loose = np.flatnonzero(parent != np.arange(len(prints)))
        codes, kids = [], []
        while len(loose):
            code = parent[loose] * 65 + distance(prints[loose], prints[parent[loose]])
            edge, at, group = np.unique(code, return_index=True, return_inverse=True)
            child = loose[at]                       # the first of each (parent, distance) becomes a node, the others go below it
            codes.append(edge)
            kids.append(child)
            parent[loose] = child[group]
            loose = loose[parent[loose] != loose]
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        order = np.argsort(code)
        self.code, self.kid = code[order], (np.concatenate(kids) if kids else np.zeros(0, np.int64))[order]

    def within(self, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) at a distance of at most ``radius``; ``query`` are positions of prints, searched in their own tree."""
        node, left, right = self.root[query], [], []
        while len(query):
            d = distance(self.prints[query], self.prints[node])
            near = d <= radius
            left.append(query[near])
            right.append(node[near])
            low = np.searchsorted(self.code, node * 65 + np.maximum(d - radius, 0), "left")
            n = np.searchsorted(self.code, node * 65 + np.minimum(d + radius, 64), "right") - low
            query = np.repeat(query, n)
            node = self.kid[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return np.concatenate(left), np.concatenate(right)


def links(prints: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star per group of linked prints: positions of members and of their group's head, for groups of two or more."""
    forest, label = Forest(prints, bucket), np.arange(len(prints))
    for at in range(0, len(prints), SLICE):
        a, b = forest.within(np.arange(at, min(at + SLICE, len(prints))), radius)
        while True:
            low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            apart = low < high
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            up = np.arange(len(prints))
            np.minimum.at(up, high[apart], low[apart])
            while (up[up] != up).any():
                up = up[up]
            label = up[label]
    member = np.flatnonzero(label != np.arange(len(prints)))
    return member, label[member]
