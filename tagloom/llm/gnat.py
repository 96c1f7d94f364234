"""A multiway hyperplane tree over vectors, with distance ranges between siblings.

A node has several split points, and a vector goes to the nearest one, so that the parts
are bounded by the hyperplanes between each two of them. Every split point keeps the range
of its distances to the vectors below each sibling (and below itself). A search for the
inner products of a window looks, for each child, for vectors in an annulus around the
query; the child is left out where the ranges of any split point show that the annulus and
the child's vectors cannot meet.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

SLACK = 1e-6  # share of the lengths by which rounding may move a distance


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0))


@dataclass
class Node:
    points: np.ndarray  # split points
    children: list[int]  # a node, or -1 - leaf
    near: np.ndarray = field(default=None)  # least distance of split point i to the vectors below child j
    far: np.ndarray = field(default=None)
    norms: np.ndarray = field(default=None)  # (2, children): least and largest squared length


class Tree:
    """Fitted on a sample; the ranges come from all vectors, see ``set_ranges``."""

    def __init__(self, sample: np.ndarray, leaf_size: int, fanout: int = 8, seed: int = 0):
        self.nodes: list[Node] = []
        self.paths: list[list[tuple[int, int]]] = []  # (node, child) steps to each leaf
        self._rng = np.random.default_rng(seed)
        self._build(sample, leaf_size, fanout, [])

    def _build(self, points: np.ndarray, leaf_size: int, fanout: int, path: list) -> int:
        split = self._split_points(points, fanout) if len(points) > leaf_size else points[:0]
        if len(split) < 2:
            self.paths.append(path)
            return -len(self.paths)
        at = len(self.nodes)
        self.nodes.append(Node(split, []))
        nearest = distances(points, split).argmin(1)
        self.nodes[at].children = [self._build(points[nearest == j], leaf_size, fanout, [*path, (at, j)]) for j in range(len(split))]
        return at

    def _split_points(self, points: np.ndarray, fanout: int) -> np.ndarray:
        """Of three times as many random vectors, one after the other that is farthest
        from those taken; equal vectors are taken once."""
        some = np.unique(points[self._rng.choice(len(points), min(len(points), 3 * fanout), replace=False)], axis=0)
        taken = [int(self._rng.integers(len(some)))]
        away = distances(some, some[taken])[:, 0]
        while len(taken) < min(fanout, len(some)):
            taken.append(int(away.argmax()))
            away = np.minimum(away, distances(some, some[taken[-1:]])[:, 0])
        return some[taken]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))] if self.nodes else []
        while todo:
            at, rows = todo.pop()
            nearest = distances(x[rows], self.nodes[at].points).argmin(1)
            for j, child in enumerate(self.nodes[at].children):
                below = rows[nearest == j]
                if child < 0:
                    out[below] = -1 - child
                elif len(below):
                    todo.append((child, below))
        return out

    def ranges(self, leaf: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest squared length of vectors of a leaf and, for each step of its
        path, least and largest distance to each split point, in one row each."""
        values = [(x * x).sum(1)[:, None]] + [distances(x, self.nodes[at].points) for at, _ in self.paths[leaf]]
        values = np.concatenate(values, axis=1)
        return values.min(0), values.max(0)

    def set_ranges(self, low: dict[int, np.ndarray], high: dict[int, np.ndarray]) -> None:
        """Take over the ranges of all leaves; leaves without vectors are missing."""
        for node in self.nodes:
            n = len(node.children)
            node.near, node.far = np.full((n, n), np.inf), np.full((n, n), -np.inf)
            node.norms = np.array([np.full(n, np.inf), np.full(n, -np.inf)])
        for leaf in low:
            at = 1
            for k, j in self.paths[leaf]:
                node, n = self.nodes[k], len(self.nodes[k].children)
                node.near[:, j] = np.minimum(node.near[:, j], low[leaf][at:at + n])
                node.far[:, j] = np.maximum(node.far[:, j], high[leaf][at:at + n])
                node.norms[0, j], node.norms[1, j] = min(node.norms[0, j], low[leaf][0]), max(node.norms[1, j], high[leaf][0])
                at += n

    def visits(self, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> dict[int, np.ndarray]:
        """For each leaf that may hold a vector whose inner product with query i lies in
        one of its windows lo[i, w] to hi[i, w]: the queries. No such leaf is left out."""
        active = np.flatnonzero((lo <= hi).any(1))
        if not self.nodes:
            return {0: active} if len(active) else {}
        out, square = {}, (q * q).sum(1)
        todo = [(0, active)]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            to_points = distances(q[rows], node.points)
            for j, child in enumerate(node.children):
                if node.norms[0, j] > node.norms[1, j]:
                    continue  # nothing below
                slack = SLACK * (np.sqrt(square[rows]) + np.sqrt(node.norms[1, j]) + 1)
                least = np.maximum(node.near[:, j] - to_points, to_points - node.far[:, j]).max(1) - slack
                most = (to_points + node.far[:, j]).min(1) + slack
                # the annulus of each window: between these squared distances from the query
                inner = square[rows, None] + node.norms[0, j] - 2.0 * hi[rows]
                outer = square[rows, None] + node.norms[1, j] - 2.0 * lo[rows]
                meets = (inner <= np.square(most)[:, None]) & (np.square(np.maximum(least, 0))[:, None] <= outer) & (lo[rows] <= hi[rows])
                below = rows[meets.any(1)]
                if len(below) and child < 0:
                    out[-1 - child] = below
                elif len(below):
                    todo.append((child, below))
        return out
