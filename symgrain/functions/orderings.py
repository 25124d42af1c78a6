"""Elimination orders of one pattern: order[k] is the vertex eliminated k-th.

All are deterministic and give every vertex once. Most bound their work by counts, never by time.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

from symgrain.functions.graph import Graph


#: Vertices of a core whose links are kept as a matrix.
BITS = 4096


def natural(graph: Graph) -> list[int]:
    return list(range(graph.n))


def backwards(graph: Graph) -> list[int]:
    return list(range(graph.n - 1, -1, -1))


def by_degree(graph: Graph) -> list[int]:
    return graph.by_degree(range(graph.n))


def allowance(graph: Graph) -> int:
    """Steps that an order may take by default: what its published bound asks of a sparse pattern, many times over."""
    return 400 * (graph.n + graph.nnz) + 20_000_000


def by_components(graph: Graph, make: Callable[[Graph], list[int]]) -> list[int]:
    """The orders of the connected components, which do not touch each other's columns, one after another."""
    parts = graph.components()
    return make(graph) if len(parts) < 2 else [part[v] for part in parts for v in make(graph.within(part))]


def leaves_first(graph: Graph) -> tuple[list[int], list[int]]:
    """Vertices with one link at most, and those that are left with as few as others go, by (links left, number): they add no entry to the factor. And all others, ascending."""
    degree, gone, order = list(graph.degree), bytearray(graph.n), []
    queue = [(d, v) for v, d in enumerate(degree) if d < 2]
    heapq.heapify(queue)
    while queue:
        d, v = heapq.heappop(queue)
        if gone[v] or d != degree[v]:
            continue
        gone[v] = 1
        order.append(v)
        for u in graph.neighbours[v]:
            if not gone[u]:
                degree[u] -= 1
                if degree[u] < 2:
                    heapq.heappush(queue, (degree[u], u))
    return order, [v for v in range(graph.n) if not gone[v]]


def rest_by_degree(graph: Graph, order: list[int]) -> list[int]:
    """The order with the vertices that it lacks behind it."""
    return order + graph.by_degree(set(range(graph.n)).difference(order))


def reverse_cuthill_mckee(graph: Graph, budget: int | None = None) -> list[int]:
    """Components by their least vertex, each walked from a peripheral vertex with neighbours by (degree, number); then all reversed. Components that are reached after the budget is spent are not searched for a peripheral vertex."""
    order: list[int] = []
    placed: set[int] = set()
    budget = allowance(graph) if budget is None else budget
    for seed in range(graph.n):
        if seed in placed:
            continue
        start = graph.peripheral(seed) if graph.degree[seed] and budget > 0 else seed
        reached = len(order)
        at = len(order)
        order.append(start)
        placed.add(start)
        while at < len(order):
            fresh = graph.by_degree(v for v in graph.neighbours[order[at]] if v not in placed)
            order += fresh
            placed.update(fresh)
            at += 1
        budget -= 8 * sum(1 + graph.degree[v] for v in order[reached:])
    return order[::-1]


def sloan(graph: Graph, far: int = 2, slim: int = 1, budget: int | None = None) -> list[int]:
    """Profile reduction after Sloan (1986), "An algorithm for profile and wavefront reduction of sparse matrices".

    A vertex's priority is ``far`` times its distance from the end, less ``slim`` times one more
    than its current degree. Vertices next to the front are active; each step numbers the vertex
    of highest priority among those active or beside them, of equals the highest number. A vertex
    that joins the numbered or the active ones lessens the current degree of its neighbours by
    one. When the budget is spent, the rest goes by degree.
    """
    budget = allowance(graph) if budget is None else budget
    order, numbered, active, listed = [], [False] * graph.n, [False] * graph.n, [False] * graph.n
    priority = [0] * graph.n

    for seed in range(graph.n):
        if numbered[seed]:
            continue
        start = graph.peripheral(seed) if graph.degree[seed] else seed
        levels = graph.walk(graph.outermost(start)[0])
        for distance, level in enumerate(levels):
            for v in level:
                priority[v] = far * distance - slim * (graph.degree[v] + 1)
        budget -= 8 * sum(1 + graph.degree[v] for level in levels for v in level)
        heap = [(-priority[start], -start)]
        listed[start] = True

        def joins(v: int, heap=heap) -> None:
            """v becomes active or numbered: its neighbours' current degrees, and so their priorities, change; they can be chosen now."""
            for w in graph.neighbours[v]:
                if not numbered[w]:
                    priority[w] += slim
                    listed[w] = True
                    heapq.heappush(heap, (-priority[w], -w))

        while heap and budget > 0:
            key, v = heapq.heappop(heap)
            v = -v
            if numbered[v] or -key != priority[v]:
                continue
            budget -= 1 + graph.degree[v]
            if not active[v]:
                joins(v)
            numbered[v] = True
            order.append(v)
            for w in graph.neighbours[v]:
                if listed[w] and not active[w] and not numbered[w]:
                    active[w] = True
                    budget -= graph.degree[w]
                    priority[w] += slim
                    heapq.heappush(heap, (-priority[w], -w))
                    joins(w)
        if budget <= 0:
            return rest_by_degree(graph, order)
    return order


def _dissect(graph: Graph, leaf: int, budget: int, split) -> list[int]:
    """Splits vertex sets into left, right and separator, which comes last; sets of up to ``leaf`` go by degree. Right halves are split first, and each split costs its size."""
    order = [0] * graph.n
    tasks = [(list(range(graph.n)), 0)]
    while tasks:
        part, low = tasks.pop()
        if len(part) <= leaf or budget < 0:
            order[low : low + len(part)] = graph.by_degree(part)
            continue
        budget -= len(part)
        left, cut, right = split(part)
        if not left and not right:
            order[low : low + len(part)] = graph.by_degree(cut)
            continue
        middle, top = low + len(left), low + len(left) + len(right)
        order[top : top + len(cut)] = cut
        tasks += [(p, at) for p, at in ((left, low), (right, middle)) if p]
    return order


def _outer_seed(graph: Graph, part: list[int], inside: set[int]) -> int:
    """The slimmest vertex of the last level from the part's slimmest vertex."""
    return graph.slimmest(graph.walk(graph.slimmest(part), inside.__contains__)[-1])


def nested_dissection(graph: Graph, leaf: int = 200) -> list[int]:
    """Separators are the middle levels of walks; what a walk does not reach goes right."""

    def split(part):
        inside = set(part)
        levels = graph.walk(_outer_seed(graph, part, inside), inside.__contains__)
        reached, upto, middle = sum(map(len, levels)), 0, 0
        for middle, level in enumerate(levels):
            upto += len(level)
            if upto >= (reached + 1) // 2:
                break
        depth = {v: k for k, level in enumerate(levels) for v in level}
        lists = {-1: [], 0: [], 1: []}
        for v in part:
            k = depth.get(v, len(levels))
            lists[(k > middle) - (k < middle)].append(v)
        return lists[-1], lists[0], lists[1]

    return _dissect(graph, leaf, 64 * graph.n + 4096, split)


def grown_dissection(graph: Graph, leaf: int = 100) -> list[int]:
    """Halves are grown greedily from an outer seed by the vertex with most links into the half, against all its links; the side with fewer border vertices gives the separator, the grown one if equal. Leaves go before all that."""
    leaves, core = leaves_first(graph)
    graph = graph.within(core)

    def split(part):
        inside = set(part)
        seed = _outer_seed(graph, part, inside)
        grown = {seed}
        total = {v: sum(w in inside for w in graph.neighbours[v]) for v in part}
        gain = lambda v: 2 * sum(w in grown for w in graph.neighbours[v]) - total[v]
        queue = [(-gain(v), v) for v in graph.neighbours[seed] if v in inside]
        heapq.heapify(queue)
        while len(grown) < (len(part) + 1) // 2 and queue:
            value, v = heapq.heappop(queue)
            if v in grown:
                continue
            now = -gain(v)
            if now != value:
                heapq.heappush(queue, (now, v))
                continue
            grown.add(v)
            for w in graph.neighbours[v]:
                if w in inside and w not in grown:
                    heapq.heappush(queue, (-gain(w), w))
        border = [v for v in part if any(w in inside and (w in grown) != (v in grown) for w in graph.neighbours[v])]
        ours, theirs = [v for v in border if v in grown], [v for v in border if v not in grown]
        cut = ours if len(ours) <= len(theirs) else theirs
        gone = set(cut)
        return [v for v in part if v in grown and v not in gone], cut, [v for v in part if v not in grown and v not in gone]

    return leaves + [core[v] for v in _dissect(graph, leaf, 96 * graph.n + 8192, split)]


def minimum_fill(graph: Graph, budget: int | None = None) -> list[int]:
    """Eliminates the vertex whose neighbours lack fewest links among themselves, then of least degree, then of least number, to the last vertex.

    With a budget, each pivot is charged as a full scan for it would be, and once it is spent the
    rest goes by current degree. Leaves, which lack nothing and are of least degree, go first
    without scans.
    """
    order, core = leaves_first(graph)
    gone = set(order)
    near = [set() if v in gone else {u for u in x if u not in gone} for v, x in enumerate(graph.neighbours)]
    alive = dict.fromkeys(core)
    lack: dict[int, int] = {}
    queue: list[tuple[int, int, int]] = []
    charge = sum(len(near[v]) ** 2 // 2 + 1 for v in core)
    while len(alive) > BITS:
        if budget is not None:
            if budget < 0:
                return order + sorted(alive, key=lambda v: (len(near[v]), v))
            budget -= charge
        for v in alive if not queue else touched:  # noqa: F821
            if v in alive:
                ring = near[v]
                lack[v] = (len(ring) * (len(ring) - 1) - sum([len(ring & near[x]) for x in ring])) // 2
                heapq.heappush(queue, (lack[v], len(ring), v))
        while True:
            value, degree, pivot = heapq.heappop(queue)
            if pivot in alive and value == lack[pivot] and degree == len(near[pivot]):
                break
        if not value and degree == len(alive) - 1:
            return order + sorted(alive)  # all are linked with each other
        order.append(pivot)
        del alive[pivot]
        ring = near[pivot]
        charge -= sum(len(near[x]) ** 2 // 2 + 1 for x in ring) + len(ring) ** 2 // 2 + 1
        touched = set(ring)
        for x in ring:
            fresh = ring - near[x] - {x}
            if fresh:
                touched |= near[x]
            near[x] |= fresh
            near[x].discard(pivot)
        charge += sum(len(near[x]) ** 2 // 2 + 1 for x in ring)
    core = list(alive)
    place = {v: k for k, v in enumerate(core)}
    linked = np.zeros((len(core), len(core)), np.float32)
    for k, v in enumerate(core):
        linked[k, [place[u] for u in near[v]]] = 1
    return order + [core[k] for k in _filled(linked, budget)]


def _filled(linked: np.ndarray, budget: int | None) -> list[int]:
    """Minimum fill of a matrix of ones where vertices are linked, which it changes. What a vertex's neighbours lack is kept up to date by products of the pivot's ring."""
    n = len(linked)
    degree = linked.sum(1, dtype=np.float64).astype(np.int64)
    closed = ((linked @ linked) * linked).sum(1, dtype=np.float64).astype(np.int64)  # twice the links among neighbours
    key = ((degree * (degree - 1) - closed) // 2 * (n + 1) + degree) * n + np.arange(n)
    none, alive, order = np.iinfo(np.int64).max, np.ones(n, bool), []
    for left in range(n, 0, -1):
        if budget is not None:
            if budget < 0:
                rest = np.flatnonzero(alive)
                return order + rest[np.argsort(degree[rest], kind="stable")].tolist()
            budget -= int((degree[alive] ** 2 // 2 + 1).sum())
        pivot = int(np.argmin(key))
        if degree[pivot] == left - 1 and key[pivot] < (n + 1) * n:
            return order + np.flatnonzero(alive).tolist()  # all are linked with each other
        order.append(pivot)
        alive[pivot], key[pivot] = False, none
        ring = np.flatnonzero(linked[pivot])
        linked[pivot] = 0
        linked[:, pivot] = 0
        if not len(ring):
            continue
        known = linked[np.ix_(ring, ring)]
        rows = linked[ring]
        rows[:, ring] = 0
        beside = np.flatnonzero(rows.sum(0))
        rows = rows[:, beside]
        lacking = 1 - known
        np.fill_diagonal(lacking, 0)
        # Vertices beside the ring: pairs of their neighbours in it that were not linked.
        closed[beside] += ((lacking @ rows) * rows).sum(0, dtype=np.float64).astype(np.int64)
        # The ring's own: links with the pivot go; pairs within the ring, and of the ring with what is beside it, come.
        inner = known.sum(1, dtype=np.float64).astype(np.int64)
        pairs = ((known @ known) * known).sum(1, dtype=np.float64).astype(np.int64)
        across = ((lacking @ rows) * rows).sum(1, dtype=np.float64).astype(np.int64)
        closed[ring] += (len(ring) - 1) * (len(ring) - 2) - pairs + 2 * across - 2 * inner
        degree[ring] += len(ring) - 2 - inner
        linked[np.ix_(ring, ring)] = 1
        linked[ring, ring] = 0
        touched = np.concatenate([ring, beside])
        key[touched] = ((degree[touched] * (degree[touched] - 1) - closed[touched]) // 2 * (n + 1) + degree[touched]) * n + touched
    return order
