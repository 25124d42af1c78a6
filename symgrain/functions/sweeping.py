"""Breadth-first sweeps in arrays, and the orders built on them, of a part of a pattern that a task holds.

A part's vertices are numbered from 0 by their numbers in the pattern, ascending; column j's
neighbours, ascending, are rows[at[j] : at[j + 1]]. Results are those of the same orders as tables
(``operators.sweeps``) and of the kernels on lists (``functions.orderings``).
"""

from __future__ import annotations

import numpy as np


def links_of(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """at, rows of n vertices with links (a, b), each once."""
    owner, near = np.concatenate([a, b]), np.concatenate([b, a])
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]), near[np.lexsort((near, owner))]


def near(at: np.ndarray, rows: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many neighbours each of some vertices has, and these one after another."""
    sizes = at[some + 1] - at[some]
    return sizes, rows[np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(at[some], sizes)]


def levels(at: np.ndarray, rows: np.ndarray, start: int | np.ndarray, level: np.ndarray) -> list[np.ndarray]:
    """Levels from start, or from starts that cannot reach each other, each in the order of discovery: by first discoverer, then as rows are listed. level: -1 for what may be reached; it is set in place."""
    front, found = np.atleast_1d(start), []
    level[start] = 0
    while len(front):
        found.append(front)
        ahead = near(at, rows, front)[1]
        ahead = ahead[level[ahead] == -1]
        front = ahead[np.sort(np.unique(ahead, return_index=True)[1])]
        level[front] = len(found)
    return found


def _slimmest(vertices: np.ndarray, degree: np.ndarray) -> int:
    """The first of those of least degree."""
    return int(vertices[np.argmin(degree[vertices])])


def cuthill_mckee(at: np.ndarray, rows: np.ndarray, degree: np.ndarray, component: np.ndarray, jumps: int = 5) -> np.ndarray:
    """Vertices by component, as they are discovered from a peripheral vertex of each with neighbours by (degree, number); all components at once. component: each vertex's, from 0."""
    starts = np.unique(component, return_index=True)[1]
    depth, going = np.zeros(len(starts), np.int64), np.arange(len(starts))
    for _ in range(jumps):
        level = np.full(len(degree), -1)
        found = np.concatenate(levels(at, rows, starts[going], level))
        last = np.zeros(len(starts), np.int64)
        np.maximum.at(last, component[found], level[found])
        outer = found[level[found] == last[component[found]]]
        outer = outer[np.lexsort((np.arange(len(outer)), degree[outer], component[outer]))]
        far = outer[np.unique(component[outer], return_index=True)[1]]  # one for each going component, ascending
        deeper = last[going] > depth[going]
        going, far = going[deeper], far[deeper]
        if not len(going):
            break
        starts[going], depth[going] = far, last[going]
    owner = np.repeat(np.arange(len(degree)), np.diff(at))
    slim = rows[np.lexsort((rows, degree[rows], owner))]
    found = np.concatenate(levels(at, slim, starts, np.full(len(degree), -1)))
    return found[np.argsort(component[found], kind="stable")]


def labels(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The least of n vertices that each can reach by links (x, y)."""
    label = np.arange(n)
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (further := label[label] != label).any():
            label[further] = label[label[further]]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    return label


def peeled(at: np.ndarray, rows: np.ndarray, degree: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How a dissection takes a connected part apart, step by step, if it goes on with what lies right: of each vertex its step, and whether it lies left there, else in the middle; and of each step the slimmest vertex of the piece that it splits.

    What lies right falls into pieces, of which that with the slimmest vertex is next. A piece's
    slimmest vertex is no slimmer than that of the piece it came from, so steps go by it.
    """
    n = len(degree)
    step, left, level, number = np.empty(n, np.int64), np.zeros(n, bool), np.full(n, -2), np.full(n, -1)
    keys: list[int] = []
    pieces = [np.arange(n)] if n else []
    for some in pieces:
        level[some] = -1
        key = _slimmest(some, degree)
        far = _slimmest(levels(at, rows, key, level)[-1], degree)
        level[some] = -1
        upto = np.cumsum([len(x) for x in levels(at, rows, far, level)])
        own = level[some]
        level[some] = -2
        median = int(np.argmax(upto >= (upto[-1] + 1) // 2))
        step[some], left[some] = len(keys), own < median
        keys.append(key)
        right = some[own > median]
        if not len(right):
            continue
        number[right] = np.arange(len(right))
        sizes, to = near(at, rows, right)
        to = number[to]
        x, y = np.repeat(np.arange(len(right)), sizes)[to >= 0], to[to >= 0]
        number[right] = -1
        linked = np.zeros(len(right), bool)
        linked[x] = True
        lone = right[~linked]
        step[lone] = len(keys) + np.arange(len(lone))
        keys += lone.tolist()
        label = labels(x, y, len(right))[linked]
        by_label = np.argsort(label, kind="stable")
        pieces += np.split(right[linked][by_label], np.flatnonzero(np.diff(label[by_label])) + 1) if len(label) else []
    slim = np.array(keys, np.int64)
    order = np.lexsort((np.arange(len(slim)), slim, degree[slim]))
    rank = np.empty(len(slim), np.int64)
    rank[order] = np.arange(len(slim))
    return rank[step], left, slim[order]


def dissected(at: np.ndarray, rows: np.ndarray, degree: np.ndarray, leaf: int, begin: int, turn: int, stop: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each vertex the first place of the part or separator that it ends in, its rank there, and the last round in which it was in a part that was split. The whole part begins at ``begin`` in round ``turn``; from round ``stop`` on nothing is split."""
    block, rank, until = np.empty(len(degree), np.int64), np.zeros(len(degree), np.int64), np.empty(len(degree), np.int64)
    level, parts = np.full(len(degree), -2), [(begin, np.arange(len(degree)))]

    def settle(some, place, ranked, last):
        block[some], until[some] = place, last
        if ranked:
            rank[some] = degree[some]

    while parts:
        following = []
        for first, some in parts:
            if len(some) <= leaf or (stop is not None and turn >= stop):
                settle(some, first, True, turn - 1)
                continue
            level[some] = -1
            far = _slimmest(levels(at, rows, _slimmest(some, degree), level)[-1], degree)
            level[some] = -1
            sizes = np.array([len(x) for x in levels(at, rows, far, level)])
            own, upto = level[some], np.cumsum(sizes)
            level[some] = -2
            median = int(np.argmax(upto >= (upto[-1] + 1) // 2))
            rest = len(some) - int(sizes[median])
            middle, left = own == median, (own >= 0) & (own < median)
            settle(some[middle], first + rest if rest else first, not rest, turn)
            halves = (first, some[left]), (first + int(left.sum()), some[~left & ~middle])
            following += [(place, half) for place, half in halves if len(half)]
        parts, turn = following, turn + 1
    return block, rank, until
