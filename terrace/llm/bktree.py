"""BK-trees over 64-bit fingerprints as flat arrays.

Many small trees (one for each shard) live in one forest. A node's children are keyed by
their integer Hamming distance to it; a search at radius r from a node at distance d
follows only the edges keyed d-r to d+r. Building and searching go level by level over
all items at once, each level a few numpy operations.
"""

from __future__ import annotations

import numpy as np

_KEYS = 65


class Forest:
    """shard: shard number of each item, ascending; value: uint64 fingerprints. Equal ones stand below each other at distance 0."""

    def __init__(self, shard: np.ndarray, value: np.ndarray):
        self.value = value
        n = len(value)
        first = np.ones(n, bool)
        first[1:] = shard[1:] != shard[:-1]
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1] if n else np.zeros(0, np.int64)
        at, left = self.root.copy(), np.flatnonzero(~first)
        edges, nodes = [], []
        while len(left):
            edge = at[left] * _KEYS + np.bitwise_count(value[left] ^ value[at[left]])
            order = np.argsort(edge, kind="stable")
            sorted_edge, sorted_item = edge[order], left[order]
            head = np.ones(len(order), bool)
            head[1:] = sorted_edge[1:] != sorted_edge[:-1]
            child = sorted_item[head]
            edges.append(sorted_edge[head])
            nodes.append(child)
            at[sorted_item] = child[np.cumsum(head) - 1]
            left = np.sort(sorted_item[~head])
        edge = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        order = np.argsort(edge)
        self.edge = edge[order]
        self.child = (np.concatenate(nodes) if nodes else np.zeros(0, np.int64))[order]

    def earlier_within(self, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, distance) for the items within the radius that stand before the query in its shard."""
        at, found = self.root[query], ([], [], [])
        while len(query):
            d = np.bitwise_count(self.value[query] ^ self.value[at]).astype(np.int64)
            hit = (d <= radius) & (at < query)
            for out, part in zip(found, (query, at, d), strict=True):
                out.append(part[hit])
            low = np.searchsorted(self.edge, at * _KEYS + np.maximum(d - radius, 0))
            high = np.searchsorted(self.edge, at * _KEYS + np.minimum(d + radius, 64), "right")
            count = high - low
            slot = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            query, at = np.repeat(query, count), self.child[slot]
            keep = at < query  # a node's subtree holds later items only
            query, at = query[keep], at[keep]
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the classes of a[i] and b[i] in place; label[i] ends as the smallest item of i's class."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label[:] = jumped
