"""A small classification tree in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Node:
    share: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1) -> Node:
    """Split by the cut that leaves the least Gini impurity, until leaves are pure, small or deep."""
    node = Node(float(y.mean()))
    if depth == 0 or node.share in (0.0, 1.0) or len(y) < 2 * least:
        return node
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        values, hits = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        ones, rest = hits[:-1], hits[-1] - hits[:-1]
        m = len(y) - n
        impurity = ones * (1 - ones / n) + rest * (1 - rest / m)
        impurity[values[1:] == values[:-1]] = np.inf
        impurity[(n < least) | (m < least)] = np.inf
        at = int(impurity.argmin())
        if np.isfinite(impurity[at]) and (best is None or impurity[at] < best[0] - 1e-12):
            best = (impurity[at], f, (values[at] + values[at + 1]) / 2)
    if best is None or best[0] >= len(y) * node.share * (1 - node.share) - 1e-12:
        return node
    _, node.feature, node.cut = best
    low = x[:, node.feature] <= node.cut
    node.low, node.high = grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)
    return node


def positive(node: Node, row: list[float]) -> bool:
    while node.low is not None:
        node = node.low if row[node.feature] <= node.cut else node.high
    return node.share >= 0.5
