"""Vector columns, and a forest of random-projection trees over a bounded sample."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null, of finite components, not zero. Never null itself."""
    x = F.col(vector)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(x, lambda c: c != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


class Forest:
    """Trees of random projections. A node splits by the direction between two random points, at the median of the sample."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.trees, self.leaves = [], []
        for _ in range(trees):
            nodes: list[tuple] = []  # (direction, cut, left, right), or (None, leaf number)
            stack, number = [(np.arange(len(sample)), None, 0)], 0
            while stack:
                own, parent, side = stack.pop()
                if parent is not None:
                    nodes[parent][2 + side] = len(nodes)
                split = None
                if len(own) > max(1, leaf):
                    for _ in range(3):
                        a, b = sample[rng.choice(own, 2, replace=False)]
                        w = (a - b) / (np.linalg.norm(a - b) or 1)
                        p = sample[own] @ w
                        cut = np.median(p)
                        if (p < cut).any() and (p >= cut).any():
                            split = w, cut, p < cut
                            break
                if split is None:  # few points, or all the same
                    nodes.append([None, number, 0, 0])
                    number += 1
                else:
                    w, cut, left = split
                    nodes.append([w, cut, 0, 0])
                    stack += [(own[left], len(nodes) - 1, 0), (own[~left], len(nodes) - 1, 1)]
            self.trees.append(nodes)
            self.leaves.append(number)

    def leaf_numbers(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.zeros((len(x), len(self.trees)), np.int64)
        for t, nodes in enumerate(self.trees):
            stack = [(0, np.arange(len(x)))]
            while stack:
                k, own = stack.pop()
                w, cut, left, right = nodes[k]
                if w is None:
                    out[own, t] = cut
                elif len(own):
                    less = x[own] @ w < cut
                    stack += [(left, own[less]), (right, own[~less])]
        return out

    def visits(self, q: np.ndarray, sizes: list[np.ndarray], budget: float) -> list[tuple[int, int]]:
        """Leaves of all trees in the order of one shared priority queue, nearest split first, until they hold `budget` rows."""
        heap, found, held = [(0.0, t, 0) for t in range(len(self.trees))], [], 0
        while heap and held < budget:
            margin, t, k = heapq.heappop(heap)
            nodes = self.trees[t]
            while (node := nodes[k])[0] is not None:
                d = float(q @ node[0]) - node[1]
                near, far = (node[3], node[2]) if d >= 0 else (node[2], node[3])
                heapq.heappush(heap, (max(margin, abs(d)), t, far))
                k = near
            found.append((t, node[1]))
            held += int(sizes[t][node[1]])
        return found


def sample_of(rows: DataFrame, key: str, vector: str, most: int) -> np.ndarray:
    """At most `most` vectors, those with the smallest hash of their key: a documented bound for fitting an index."""
    got = rows.select(F.col(vector).alias("x"), F.xxhash64(key).alias("h"), F.col(key).alias("k")).orderBy("h", "k").limit(most).select("x").toArrow()
    return matrix(got.column("x"))
