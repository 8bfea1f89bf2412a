"""BK-trees over 64-bit fingerprints, many at once: children hang on an edge labelled with their integer Hamming distance to the parent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """Trees over `values`; rows with one `tree` number (ascending) make one tree, rooted at the first. Values within a tree are distinct."""

    def __init__(self, values: np.ndarray, tree: np.ndarray):
        n = len(values)
        self.values, self.tree = values, tree
        first = np.concatenate([[True], tree[1:] != tree[:-1]]) if n else np.zeros(0, bool)
        self.roots = np.flatnonzero(first)
        root_of = self.roots[np.cumsum(first) - 1] if n else self.roots
        pending, node = np.flatnonzero(~first), root_of[~first]
        keys, kids = [], []
        while len(pending):
            edge = node * 65 + distance(values[pending], values[node])
            taken, winner, which = np.unique(edge, return_index=True, return_inverse=True)
            child = pending[winner]  # the first to come to an edge hangs there, the others go on below it
            keys.append(taken)
            kids.append(child)
            node = child[which]
            on = node != pending
            pending, node = pending[on], node[on]
        self.edges = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.children = np.concatenate(kids) if kids else np.zeros(0, np.int64)
        order = np.argsort(self.edges)
        self.edges, self.children = self.edges[order], self.children[order]

    def within(self, values: np.ndarray, roots: np.ndarray, radius: int, block: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) at most `radius` apart; a search starts at its root and follows only edges within the radius of its distance."""
        for start in range(0, len(values), block):
            query = np.arange(start, min(start + block, len(values)))
            node = roots[query]
            while len(query):
                d = distance(values[query], self.values[node])
                near = d <= radius
                if near.any():
                    yield query[near], node[near]
                low = np.searchsorted(self.edges, node * 65 + np.maximum(d - radius, 0))
                high = np.searchsorted(self.edges, node * 65 + np.minimum(d + radius, 64), "right")
                count = high - low
                at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
                query, node = np.repeat(query, count), self.children[at]


def joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the sets of a and b in a parent array; the smaller index becomes the root."""
    while len(a):
        a, b = find(parent, a), find(parent, b)
        on = a != b
        a, b = a[on], b[on]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = parent[up]
