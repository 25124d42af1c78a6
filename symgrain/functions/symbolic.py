"""What eliminating a pattern in a given order costs: elimination tree and column counts."""

from __future__ import annotations

import numpy as np

from symgrain.functions.graph import Graph


def reordered(graph: Graph, order) -> Graph:
    """The pattern with vertex order[k] renamed k."""
    order = np.asarray(order, np.int64)
    place = np.empty(graph.n, np.int64)
    place[order] = np.arange(graph.n)
    sizes = np.array(graph.degree, np.int64)
    a = np.repeat(np.arange(graph.n), sizes)
    b = np.array([v for row in graph.neighbours for v in row], np.int64)
    return Graph.edges(graph.n, place[a], place[b])


def elimination_tree(graph: Graph) -> list[int]:
    """Parent of each column, -1 for roots (Liu 1986); natural order."""
    parent, top = [-1] * graph.n, [-1] * graph.n
    for j, row in enumerate(graph.neighbours):
        for i in row:
            if i >= j:
                break
            while i != -1 and i != j:
                i, up = top[i], i
                top[up] = j
                if i == -1:
                    parent[up] = j
    return parent


def column_counts(graph: Graph, parent: list[int] | None = None) -> list[int]:
    """Entries of each factor column, diagonal included, natural order.

    After Gilbert, Ng and Peyton: a column's count is a sum over its subtree of +1 for each leaf
    of a row subtree, -1 where two leaves' paths meet, and -1 for each child; path-compressed
    search finds the meeting points, so the time is near linear in the pattern's entries.
    """
    n = graph.n
    parent = elimination_tree(graph) if parent is None else parent
    children: list[list[int]] = [[] for _ in range(n)]
    for v in range(n - 1, -1, -1):
        if parent[v] >= 0:
            children[parent[v]].append(v)
    post, stack = [], [r for r in range(n - 1, -1, -1) if parent[r] < 0]
    while stack:
        v = stack.pop()
        if v < 0:
            post.append(~v)
        else:
            stack.append(~v)
            stack.extend(children[v])
    lowest, rank = [0] * n, 0  # the rank of the first of each subtree
    for rank, v in enumerate(post):
        lowest[v] = min([rank, *(lowest[c] for c in children[v])])
    delta = [int(not children[v]) for v in range(n)]
    group, last_leaf, reached = list(range(n)), [-1] * n, [-1] * n
    for v in post:
        up = parent[v]
        if up >= 0:
            delta[up] -= 1
        for i in graph.neighbours[v]:
            if i > v and lowest[v] > reached[i]:
                reached[i] = lowest[v]
                delta[v] += 1
                meet = last_leaf[i]
                if meet >= 0:
                    while group[meet] != meet:
                        group[meet] = group[group[meet]]
                        meet = group[meet]
                    delta[meet] -= 1
                last_leaf[i] = v
        if up >= 0:
            group[v] = up
    for v in post:
        if parent[v] >= 0:
            delta[parent[v]] += delta[v]
    return delta


def column_counts_by_rows(graph: Graph, parent: list[int] | None = None) -> list[int]:
    """The same by walking every row's subtree: as long as the factor is, and independent of the above."""
    parent = elimination_tree(graph) if parent is None else parent
    counts, seen = [1] * graph.n, [-1] * graph.n
    for i, row in enumerate(graph.neighbours):
        seen[i] = i
        for k in row:
            while k < i and seen[k] != i:
                seen[k] = i
                counts[k] += 1
                k = parent[k]
    return counts


def score(graph: Graph, order) -> tuple[int, int]:
    """(entries of the factor, sum of squared column counts)."""
    counts = column_counts(reordered(graph, order))
    return sum(counts), sum(c * c for c in counts)


def is_order(order, n: int) -> bool:
    order = np.asarray(order, np.int64)
    return len(order) == n and bool((np.sort(order) == np.arange(n)).all())
