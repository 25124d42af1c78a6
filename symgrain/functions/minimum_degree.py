"""Approximate minimum degree and minimum fill on a quotient graph.

After Amestoy, Davis and Duff (1996): eliminated pivots become elements, each standing for a
clique; a variable's degree is bounded from its links, the pivot's element and what the other
elements have outside that; elements that a pivot covers are absorbed; variables with equal
links merge; variables left with the pivot's element alone are eliminated with it. Rows of more
than ``dense`` x sqrt(n) entries (16 at least) are put off to the end.
"""

from __future__ import annotations

import heapq
import math

from symgrain.functions.graph import Graph
from symgrain.functions.orderings import allowance


def minimum_degree(graph: Graph, aggressive: bool = True, dense: float = 10.0, fill: bool = False, budget: int | None = None) -> list[int]:
    """The order of elimination. aggressive: also absorbs elements that the pivot's covers without touching the pivot. fill: picks by estimated fill instead of degree. dense: negative for no dense rows. Of equals the least number goes first. When the budget of visited entries is spent, the variables left go by their bounds."""
    n = graph.n
    limit = n if dense < 0 else max(16, dense * math.sqrt(n))
    late = {v for v in range(n) if graph.degree[v] > limit}
    links = [set() if v in late else set(graph.neighbours[v]) - late for v in range(n)]
    touches: list[set[int]] = [set() for _ in range(n)]  # elements at each variable
    members: dict[int, set[int]] = {}  # variables of each element
    weight = [0 if v in late else 1 for v in range(n)]
    merged: list[list[int]] = [[v] for v in range(n)]
    degree = [len(x) for x in links]
    cost = [d * (d - 1) if fill else d for d in degree]
    left, order = n - len(late), []
    budget = allowance(graph) if budget is None else budget

    # Leaves first, as the queue would have it; their elements cover nothing.
    queue = [(cost[v], v) for v in range(n) if degree[v] < 2 and v not in late]
    heapq.heapify(queue)
    while queue:
        value, v = heapq.heappop(queue)
        if not weight[v] or value != cost[v]:
            continue
        order.append(v)
        weight[v] = 0
        budget -= 2
        for u in links[v]:
            links[u].discard(v)
            degree[u] = d = len(links[u])
            cost[u] = d * (d - 1) if fill else d
            if not d:
                order.append(u)
                weight[u] = 0
            elif d < 2:
                heapq.heappush(queue, (cost[u], u))
        links[v] = set()
    left -= len(order)
    queue = [(cost[v], v) for v in range(n) if weight[v]]
    heapq.heapify(queue)

    while queue:
        if budget < 0:
            for v in sorted((v for v in range(n) if weight[v]), key=lambda v: (cost[v], v)):
                order += merged[v]
            break
        value, pivot = heapq.heappop(queue)
        if not weight[pivot] or value != cost[pivot]:
            continue
        clique = set(links[pivot]).union(*(members[e] for e in touches[pivot])) - {pivot}
        for e in touches[pivot]:
            for v in members[e]:
                if v != pivot:
                    touches[v].discard(e)
            del members[e]
        order += merged[pivot]
        left -= weight[pivot]
        weight[pivot] = 0
        members[pivot] = clique
        size = sum(weight[v] for v in clique)
        budget -= 1 + sum(1 + len(links[v]) + len(touches[v]) for v in clique)

        outside: dict[int, int] = {}  # weight of each touched element beyond the clique
        for v in clique:
            links[v] -= clique
            links[v].discard(pivot)
            for e in touches[v]:
                if e not in outside:
                    outside[e] = sum(weight[u] for u in members[e])
                outside[e] -= weight[v]
        if aggressive:
            for e in [e for e, beyond in outside.items() if not beyond]:
                for v in members[e]:
                    touches[v].discard(e)
                del members[e]

        alike: dict[tuple, int] = {}
        for v in sorted(clique):
            mine = weight[v]
            if not links[v] and not touches[v]:  # nothing but the clique: goes along with the pivot
                order += merged[v]
                left -= mine
                size -= mine
                weight[v] = 0
                clique.discard(v)
                continue
            around = size - mine
            bound = sum(weight[u] for u in links[v]) + sum(outside[e] for e in touches[v])
            degree[v] = min(left - mine, degree[v] + around, bound + around)
            key = (frozenset(links[v]), frozenset(touches[v]))
            twin = alike.setdefault(key, v)
            if twin != v:
                merged[twin] += merged[v]
                weight[twin] += mine
                degree[twin] -= mine
                weight[v] = 0
                clique.discard(v)
                for u in links[v]:
                    links[u].discard(v)
                for e in touches[v]:
                    members[e].discard(v)
        for v in clique:
            touches[v].add(pivot)
            d = max(degree[v], 0)
            around = max(size - weight[v], 0)
            cost[v] = max(d * (d - 1) - around * (around - 1), 0) if fill else d
            heapq.heappush(queue, (cost[v], v))
        if not clique:
            del members[pivot]
    return order + graph.by_degree(late)
