"""Deep-shallow sorting of fixed-length strings, all groups of a level at once.

Shallow: multikey quicksort on characters of eight bytes. Every group of strings
that are equal so far takes the median of three of its strings as its pivot and
falls into the strings below, equal to and above it at the group's character; the
equal ones go on with the next character, up to the shallow depth. A round does
this for all groups together. Groups of a few strings are sorted directly.

Deep: the groups that tie at the shallow depth have long common prefixes, so each
is ordered by a blind trie, grown a path at a time. A group's first string is the
path's leaf; each other string is compared with that leaf only, from the depth on
that the group is known to share, and goes to the branch that leaves the path at
their common prefix's length with its next byte; nothing else of it is looked at.
Branches of more than one string are the groups of the next round.
"""

from __future__ import annotations

import numpy as np

#: Depth in bytes at which blind tries take over from quicksort.
SHALLOW = 16
#: Strings of a group that are sorted directly.
FEW = 16


def _groups(tied: np.ndarray) -> np.ndarray:
    """Group number of each place, given which places equal the one before."""
    return np.cumsum(~tied) - 1


def quicksort(word: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``word`` in the order of their first ``depth`` characters, and which places tie with the one before there."""
    n = len(word)
    place = np.arange(n)
    begin, size, at = np.zeros(1, np.int64), np.array([n]), np.zeros(1, np.int64)
    few = [(begin[:0], size[:0])]
    while True:
        small, live = (size > 1) & (size <= FEW), size > FEW
        few.append((begin[small], size[small]))
        begin, size, at = begin[live], size[live], at[live]
        if len(begin) == 0:
            break
        group = np.repeat(np.arange(len(begin)), size)
        first = np.cumsum(size) - size
        where = np.arange(len(group)) + np.repeat(begin - first, size)
        rows = place[where]
        key = word[rows, at[group]]
        three = np.stack([key[first], key[first + size // 2], key[first + size - 1]])
        pivot = np.sort(three, axis=0)[1][group]
        below, above = key < pivot, key > pivot
        equal = ~(below | above)
        to, start, sizes = np.empty(len(rows), np.int64), begin.copy(), []
        for side in (below, equal, above):
            run = np.cumsum(side)
            many = np.add.reduceat(side, first, dtype=np.int64)
            rank = run - 1 - np.repeat(run[first] - side[first], size)
            to[side] = (np.repeat(start, size) + rank)[side]
            sizes.append((start, many))
            start = start + many
        place[to] = rows
        deeper = at + 1
        done = deeper >= depth
        (b0, n0), (b1, n1), (b2, n2) = sizes
        begin = np.concatenate([b0, b1[~done], b2])
        size = np.concatenate([n0, n1[~done], n2])
        at = np.concatenate([at, deeper[~done], at])
    begin, size = (np.concatenate(x) for x in zip(*few, strict=True))
    if len(begin):
        group = np.repeat(np.arange(len(begin)), size)
        where = np.arange(len(group)) + np.repeat(begin - (np.cumsum(size) - size), size)
        rows = place[where]
        by = np.lexsort((*word[rows, :depth].T[::-1], group))
        place[where] = rows[by]
    return place, _tied(word[place][:, :depth])


def _tied(head: np.ndarray) -> np.ndarray:
    out = np.zeros(len(head), dtype=bool)
    out[1:] = (head[1:] == head[:-1]).all(axis=1)
    return out


def order(grid: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``grid`` (bytes, width a multiple of 8) in ascending order, and each place's group of equal rows."""
    n, width = grid.shape
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = np.ascontiguousarray(grid).view(">u8").astype(np.uint64)
    known = min(shallow, width) // 8
    place, tied = quicksort(word, known)
    group = _groups(tied)
    live = np.flatnonzero((np.bincount(group)[group] > 1) & (known < width // 8))
    group = group[live]
    middle = (width + 1) * 256
    while len(live):
        rows = place[live]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        leader = rows[first][np.cumsum(np.diff(group, prepend=group[0]) != 0)]
        unlike = word[rows, known:] != word[leader, known:]
        differs = unlike.any(axis=1)
        at = np.flatnonzero(differs)
        column = (known + unlike[at].argmax(axis=1)) * 8
        cell = column[:, None] + np.arange(8)
        bytes_a, bytes_b = grid[rows[at][:, None], cell], grid[leader[at][:, None], cell]
        inside = (bytes_a != bytes_b).argmax(axis=1)
        pick = np.arange(len(at))
        mine, its = bytes_a[pick, inside].astype(np.int64), bytes_b[pick, inside].astype(np.int64)
        common = column + inside
        key = np.full(len(rows), middle, dtype=np.int64)
        key[at] = np.where(mine < its, common * 256 + mine, middle + 1 + (width - common) * 256 + mine)
        by = np.lexsort((key, group))
        place[live] = rows[by]
        key, group = key[by], group[by]
        new = np.ones(len(live), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new) - 1
        again = (np.bincount(group)[group] > 1) & (key != middle)
        live, group = live[again], group[again]
    same = np.zeros(n, dtype=bool)
    same[1:] = (word[place[1:]] == word[place[:-1]]).all(axis=1)
    return place, _groups(same)
