"""Cover trees over a bounded block of points, as arrays.

Points are taken farthest first: each next one is the farthest from those before, at distance r. The points with r above a
scale are that far from each other, and all others lie within the scale of one of them: so they are the tree's nodes at this
scale. Scales shrink by BASE from level to level; a node's parent is the nearest node one level up. Points are stored in the order of
their paths, so that a node holds a range of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Points that a leaf holds at most, unless they are equal.
LEAF = 16
BASE = 1.3


@dataclass
class Tree:
    """order: the points' places, by node. A node: its centre (a place in order's range), the distance of its farthest point,
    the range of points start:stop, and the range first:last of its children (none: a leaf)."""

    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray
    last: np.ndarray


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b, in double precision, not below 0."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :], 0)


def farthest_first(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances): every point with its distance from those before it; the first has none (infinity)."""
    n = len(points)
    places, far = np.zeros(n, np.int64), np.full(n, np.inf)
    sizes = (points * points).sum(1)
    nearest = np.maximum(sizes - 2 * (points @ points[0]) + sizes[0], 0)
    left = np.ones(n, bool)
    left[0] = False
    for k in range(1, n):
        at = int(np.where(left, nearest, -1).argmax())
        if not nearest[at]:  # the rest are copies
            places[k:] = np.flatnonzero(left)
            far[k:] = 0
            break
        places[k], far[k], left[at] = at, np.sqrt(nearest[at]), False
        np.minimum(nearest, np.maximum(sizes - 2 * (points @ points[at]) + sizes[at], 0), out=nearest)
    return places, far


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree of n > 0 points (rows, in double precision). leaf: points that a leaf holds at most, unless they are equal."""
    n = len(points)
    places, far = farthest_first(points)
    scale = far[1] if n > 1 else 0.0
    levels = [np.zeros(n, np.int64)]  # of each level: every point's node, as the number of its centre in places
    count = 1
    while scale > 0 and np.bincount(levels[-1]).max() > leaf:
        scale /= BASE
        wide = int((far > scale).sum())
        if wide == count and wide < n:
            if far[count] <= 0:
                break
            continue
        count = wide
        centres = points[places[:count]]
        owner = squared(points, centres).argmin(1) if count < n else np.argsort(places)
        owner[places[:count]] = np.arange(count)
        # nodes go with their centre's parent, all the way up
        levels = [above[places[owner]] for above in levels]
        levels.append(owner)
    order = np.lexsort(levels[::-1])
    tree: list[list] = [[], [], [], [], [], []]
    ranges = [(0, n, 0, -1)]  # start, stop, level, parent
    for start, stop, level, parent in ranges:
        at, own = len(tree[0]), order[start:stop]
        if parent >= 0:
            if tree[4][parent] < 0:
                tree[4][parent] = at
            tree[5][parent] = at + 1
        centre = places[levels[level][own[0]]]
        radius = float(np.sqrt(squared(points[own], points[centre : centre + 1]).max()))
        for column, value in zip(tree, (centre, radius, start, stop, -1, -1), strict=True):
            column.append(value)
        while level + 1 < len(levels) and stop - start > leaf:  # levels at which a node has one child say nothing
            level += 1
            names = levels[level][own]
            cuts = np.flatnonzero(names[1:] != names[:-1]) + 1 + start
            if len(cuts):
                edges = [start, *cuts.tolist(), stop]
                ranges += [(a, b, level, at) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                break
    return Tree(order, np.array(tree[0]), np.array(tree[1]), *(np.array(x, np.int64) for x in tree[2:]))
