"""Signature trees: exact Jaccard links inside one bounded group of sets.

A set's signature is a bitmap with a bit for each of its tokens' hashes. Leaves
are the sets, ordered by size; a node holds the OR of its children's bitmaps,
the range of their sizes, and the most tokens that any of its sets has beyond
its bitmap's ones. Two nodes' sets cannot overlap by more than the bits they
have in common plus the smaller of those surpluses, nor by more than the larger
set's tokens, so a pair of nodes for which that is less than the smallest
overlap that a link needs is pruned with all pairs below it. The traversal goes
down both trees at once, a level at a time; the pairs of leaves that are left
are verified by exact intersection.
"""

from __future__ import annotations

import numpy as np

FANOUT = 8


class Tree:
    """``sets``: sorted distinct tokens of each set; ``size``: its full size, which may be larger."""

    def __init__(self, sets: list[np.ndarray], size: np.ndarray, words: int):
        self.order = np.lexsort((np.array([s[0] if len(s) else 0 for s in sets], dtype=np.uint64), size))
        sets = [sets[i] for i in self.order]
        size = size[self.order].astype(np.int64)
        bitmap = np.zeros((len(sets), words), dtype=np.uint64)
        for i, s in enumerate(sets):
            bit = s % np.uint64(words * 64)
            np.bitwise_or.at(bitmap[i], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        held = np.array([len(s) for s in sets], dtype=np.int64)
        extra = held - np.bitwise_count(bitmap).sum(axis=1, dtype=np.int64)
        self.levels = [(bitmap, size, size, held, extra)]
        while len(bitmap) > 1:
            edge = np.arange(0, len(bitmap), FANOUT)
            bitmap = np.bitwise_or.reduceat(bitmap, edge, axis=0)
            _, low, high, held, extra = self.levels[-1]
            low, high = np.minimum.reduceat(low, edge), np.maximum.reduceat(high, edge)
            held, extra = np.maximum.reduceat(held, edge), np.maximum.reduceat(extra, edge)
            self.levels.append((bitmap, low, high, held, extra))


def words_for(sets: list[np.ndarray]) -> int:
    """64-bit words of a bitmap that has about two bits for each token of the largest set."""
    need = -(-2 * max([1, *map(len, sets)]) // 64)
    return min(512, 1 << (need - 1).bit_length())


def _children(tree: Tree, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The node's children one level down, and how many each node has."""
    n = len(tree.levels[level - 1][0])
    many = np.minimum((node + 1) * FANOUT, n) - node * FANOUT
    return node * FANOUT, many


def candidates(one: Tree, two: Tree, part: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets (places in the input) that may link: ``whole`` * overlap >= ``part`` * union is still possible."""
    same = one is two
    level_a, level_b = len(one.levels) - 1, len(two.levels) - 1
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        bits_a, low_a, high_a, held_a, extra_a = one.levels[level_a]
        bits_b, low_b, high_b, held_b, extra_b = two.levels[level_b]
        common = np.concatenate([np.bitwise_count(bits_a[a[i : i + 65536]] & bits_b[b[i : i + 65536]]).sum(axis=1, dtype=np.int64) for i in range(0, len(a), 65536)] or [np.zeros(0, np.int64)])
        most = np.minimum(common + np.minimum(extra_a[a], extra_b[b]), np.minimum(held_a[a], held_b[b]))
        live = (whole + part) * most >= part * (low_a[a] + low_b[b])
        live &= (whole * high_a[a] >= part * low_b[b]) & (whole * high_b[b] >= part * low_a[a])
        a, b = a[live], b[live]
        if level_a == 0 and level_b == 0:
            break
        step_a, step_b = level_a > 0 and level_a >= level_b, level_b > 0 and level_b >= level_a
        for side in (0, 1):
            if (step_a, step_b)[side]:
                tree, level, node = ((one, level_a, a), (two, level_b, b))[side]
                first, many = _children(tree, level, node)
                down = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
                a, b = (down, np.repeat(b, many)) if side == 0 else (np.repeat(a, many), down)
        level_a, level_b = level_a - step_a, level_b - step_b
        if same:
            a, b = a[a <= b], b[a <= b]
    if same:
        a, b = a[a < b], b[a < b]
    return one.order[a], two.order[b]


def find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def links(sets: list[np.ndarray], size: np.ndarray, group: np.ndarray, others: int = 0, part: int = 75, whole: int = 100) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets.

    ``group`` names sets already known to be connected, which are not compared.
    With ``others`` only pairs of one of the first ``others`` sets with any set
    count, else all pairs.
    """
    words = words_for(sets)
    if others:
        one, two = Tree(sets[:others], size[:others], words), Tree(sets, size, words)
        a, b = candidates(one, two, part, whole)
    else:
        one = Tree(sets, size, words)
        a, b = candidates(one, one, part, whole)
    _, parent = np.unique(group, return_index=True)
    start = parent[np.searchsorted(group[parent], group)]
    parent = start.copy()
    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(parent, x), find(parent, y)
        if p == q:
            continue
        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        if whole * both >= part * (int(size[x]) + int(size[y]) - both):
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out
