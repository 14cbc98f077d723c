"""Decision trees and random forests for small labelled tables, fitted with numpy."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import TypeVar

import numpy as np

Value = TypeVar("Value")


@dataclass(frozen=True)
class Node:
    """A split (``feature`` <= ``threshold`` goes to ``low``) or, without feature, a leaf."""

    share: float
    feature: int | None = None
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _best_split(x: np.ndarray, y: np.ndarray, features: Sequence[int], least: int):
    """The split with the lowest weighted Gini impurity; ties go to the first feature and value."""
    best, rows = None, len(y)
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        values, labels = x[order, f], y[order]
        ones = np.cumsum(labels)
        n = np.arange(1, rows)
        low, high = ones[:-1], ones[-1] - ones[:-1]
        impurity = low * (1 - low / n) + high * (1 - high / (rows - n))
        allowed = (values[1:] > values[:-1]) & (n >= least) & (rows - n >= least)
        if not allowed.any():
            continue
        at = int(np.argmin(np.where(allowed, impurity, np.inf)))
        if best is None or impurity[at] < best[0] - 1e-12:
            best = (float(impurity[at]), f, float((values[at] + values[at + 1]) / 2))
    return best


def grow(
    x: np.ndarray,
    y: np.ndarray,
    *,
    depth: int,
    least: int = 1,
    draw: Callable[[], Sequence[int]] | None = None,
) -> Node:
    """A tree over features ``x`` and labels 0/1; ``draw`` gives the features a split may use."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return Node(share)
    found = _best_split(x, y, draw() if draw else range(x.shape[1]), least)
    if found is None:
        return Node(share)
    _, feature, threshold = found
    low = x[:, feature] <= threshold
    parts = [grow(x[m], y[m], depth=depth - 1, least=least, draw=draw) for m in (low, ~low)]
    return Node(share, feature, threshold, *parts)


def grow_forest(
    x: np.ndarray, y: np.ndarray, *, trees: int, depth: int, least: int = 2, seed: int = 0
) -> list[Node]:
    """Trees over bootstrap samples; every split sees a random root-sized set of features."""
    random = np.random.default_rng(seed)
    width = x.shape[1]
    some = max(1, round(width**0.5))
    made = []
    for _ in range(trees):
        rows = random.integers(0, len(y), len(y))
        made.append(
            grow(
                x[rows],
                y[rows],
                depth=depth,
                least=least,
                draw=lambda: sorted(random.choice(width, some, replace=False).tolist()),
            )
        )
    return made


def evaluate(node: Node, row: Sequence[float]) -> float:
    while node.feature is not None:
        node = node.low if row[node.feature] <= node.threshold else node.high
    return node.share


def fold(node: Node, leaf: Callable[[float], Value], split: Callable[[int, float, Value, Value], Value]) -> Value:
    """Rebuild a tree in another form, leaves first."""
    if node.feature is None:
        return leaf(node.share)
    return split(node.feature, node.threshold, fold(node.low, leaf, split), fold(node.high, leaf, split))
