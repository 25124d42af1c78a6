"""Multilevel nested dissection: coarsen by matching, split the coarsest, refine on the way back.

Stands in for the graph-partitioning libraries that a candidate list names; the knobs are the
number of trial splits and of refinement passes.
"""

from __future__ import annotations

from symgrain.functions.graph import Graph
from symgrain.functions.minimum_degree import minimum_degree
from symgrain.functions.orderings import allowance, leaves_first

COARSE, LEAF = 60, 60


def _coarsen(weights: list[int], links: list[dict[int, int]]):
    """Matches each vertex with the neighbour of heaviest link, lightest vertices first; returns the coarse vertex of each, and the coarse graph."""
    n = len(weights)
    mate = [-1] * n
    for v in sorted(range(n), key=lambda v: (len(links[v]), v)):
        if mate[v] < 0:
            free = [(-w, weights[u], u) for u, w in links[v].items() if mate[u] < 0 and u != v]
            mate[v] = v
            if free:
                u = min(free)[2]
                mate[v], mate[u] = u, v
    to, count = [-1] * n, 0
    for v in range(n):
        if to[v] < 0:
            to[v] = to[mate[v]] = count
            count += 1
    heavy, joined = [0] * count, [dict() for _ in range(count)]
    for v in range(n):
        heavy[to[v]] += weights[v]
        row = joined[to[v]]
        for u, w in links[v].items():
            if to[u] != to[v]:
                row[to[u]] = row.get(to[u], 0) + w
    return to, heavy, joined


def _grow(weights, links, seed):
    """One half of the weight, grown from seed by the strongest connection."""
    half, inside, load = sum(weights) // 2, {seed}, weights[seed]
    pull = dict(links[seed])
    while load < half and len(inside) < len(weights) - 1:
        rest = pull or {v: 0 for v in range(len(weights)) if v not in inside}
        v = min(rest, key=lambda u: (-rest[u], u))
        pull.pop(v, None)
        inside.add(v)
        load += weights[v]
        for u, w in links[v].items():
            if u not in inside:
                pull[u] = pull.get(u, 0) + w
    return [v in inside for v in range(len(weights))]


def _cut(side, links):
    return sum(w for v, row in enumerate(links) for u, w in row.items() if side[u] != side[v]) // 2


def _refine(side, weights, links, passes):
    """Moves border vertices whose move lessens the cut while neither half outgrows 60 percent."""
    most = 0.6 * sum(weights)
    load = [sum(w for w, s in zip(weights, side, strict=True) if s == k) for k in (False, True)]
    for _ in range(passes):
        moved = False
        for v, row in enumerate(links):
            gain = sum(w if side[u] != side[v] else -w for u, w in row.items())
            target = not side[v]
            better = gain > 0 or gain == 0 and load[side[v]] > load[target] + weights[v]
            if row and better and load[target] + weights[v] <= most:
                load[side[v]] -= weights[v]
                load[target] += weights[v]
                side[v] = target
                moved = True
        if not moved:
            break
    return side


def _bisect(weights, links, trials, passes):
    levels = []
    while len(weights) > COARSE:
        to, heavy, joined = _coarsen(weights, links)
        if len(heavy) > 0.95 * len(weights):
            break
        levels.append((to, weights, links))
        weights, links = heavy, joined
    step = max(len(weights) // max(trials, 1), 1)
    tried = [_refine(_grow(weights, links, seed), weights, links, passes) for seed in range(0, len(weights), step)[:trials]]
    side = min(tried, key=lambda s: _cut(s, links))
    for to, weights, links in reversed(levels):
        side = _refine([side[to[v]] for v in range(len(to))], weights, links, passes)
    return side


def multilevel_dissection(graph: Graph, trials: int = 4, passes: int = 4, budget: int | None = None) -> list[int]:
    """Leaves go first, separators come last; small parts, and all that are left when the budget is spent, go by minimum degree."""
    budget = allowance(graph) if budget is None else budget
    leaves, core = leaves_first(graph)
    graph = graph.within(core)
    order, tasks = [0] * graph.n, [(list(range(graph.n)), 0)]
    while tasks:
        part, low = tasks.pop()
        number = {v: k for k, v in enumerate(part)}
        if len(part) > LEAF and budget > 0:
            budget -= (4 + passes) * (len(part) + sum(graph.degree[v] for v in part)) + trials * (2 + passes) * COARSE**2
            links = [{number[u]: 1 for u in graph.neighbours[v] if u in number} for v in part]
            side = _bisect([1] * len(part), links, trials, passes)
            border = [[k for k, row in enumerate(links) if side[k] == s and any(side[u] != s for u in row)] for s in (False, True)]
            gone = set(min(border, key=len))
            halves = [[v for k, v in enumerate(part) if k not in gone and side[k] == s] for s in (False, True)]
            if all(halves):
                at = low
                for half in halves:
                    tasks.append((half, at))
                    at += len(half)
                order[at : at + len(gone)] = [part[k] for k in sorted(gone)]
                continue
        small = Graph([[number[u] for u in graph.neighbours[v] if u in number] for v in part])
        order[low : low + len(part)] = [part[k] for k in minimum_degree(small)]
    return leaves + [core[v] for v in order]
