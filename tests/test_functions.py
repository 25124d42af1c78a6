import random

import pytest

from symgrain.functions import multilevel, orderings
from symgrain.functions.graph import Graph
from symgrain.functions.minimum_degree import minimum_degree
from symgrain.functions.symbolic import column_counts, column_counts_by_rows, is_order, reordered, score
from symgrain.sources.generators import kkt_edges


def of(n, edges):
    return Graph.edges(n, [a for a, _ in edges], [b for _, b in edges])


def mesh(k):
    return of(k * k, [(v, v + 1) for v in range(k * k) if v % k < k - 1] + [(v, v + k) for v in range(k * k - k)])


def chance(n, m, seed):
    rng = random.Random(seed)
    return of(n, [(rng.randrange(n), rng.randrange(n)) for _ in range(m)])


def path(n):
    return of(n, [(v, v + 1) for v in range(n - 1)])


def star(n, hub):
    return of(n, [(hub, v) for v in range(n) if v != hub])


def eliminate(graph, order):
    """Counts by playing the elimination through."""
    near, out = [set(x) for x in graph.neighbours], 0
    total = 0
    for v in order:
        ring = near[v]
        out += len(ring) + 1
        total += (len(ring) + 1) ** 2
        for x in ring:
            near[x] |= ring - {x}
            near[x].discard(v)
    return out, total


SHAPES = {
    "empty": of(0, []), "one": of(1, []), "edgeless": of(12, []), "path": path(100), "hub first": star(40, 0), "mesh": mesh(20), "two paths": of(50, [(v, v + 1) for v in range(20)] + [(v, v + 1) for v in range(22, 45)]),
    "band": of(300, [(v, v + s) for s in (1, 10) for v in range(300 - s)]), "random": chance(200, 500, 3), "kkt": of(400, sorted(kkt_edges(300, 100, 5))), "dense": of(30, [(a, b) for a in range(30) for b in range(a)]),
}
ORDERS = {
    "natural": orderings.natural, "backwards": orderings.backwards, "degree": orderings.by_degree, "rcm": orderings.reverse_cuthill_mckee, "sloan": orderings.sloan, "sloan 1 2": lambda g: orderings.sloan(g, 1, 2), "nd": lambda g: orderings.nested_dissection(g, 20),
    "gggp": lambda g: orderings.grown_dissection(g, 20), "fill": orderings.minimum_fill, "poor fill": lambda g: orderings.minimum_fill(g, 1000), "amd": minimum_degree, "amd calm": lambda g: minimum_degree(g, aggressive=False), "amd all": lambda g: minimum_degree(g, dense=-1), "amd dense": lambda g: minimum_degree(g, dense=0.5), "amf": lambda g: minimum_degree(g, fill=True), "multilevel": multilevel.multilevel_dissection,
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("order", ORDERS)
def test_orders_and_counts(shape, order):
    graph = SHAPES[shape]
    found = ORDERS[order](graph)
    assert is_order(found, graph.n) and found == ORDERS[order](graph)
    moved = reordered(graph, found)
    assert column_counts(moved) == column_counts_by_rows(moved)
    assert score(graph, found) == eliminate(graph, found)


def test_closed_forms():
    assert score(of(3, [(0, 1), (0, 2), (1, 2)]), range(3)) == (6, 14)
    assert score(star(5, 0), range(5)) == (15, 55)
    assert score(path(100), range(100)) == (199, 397)
    assert score(star(1001, 1000), range(1001)) == (2001, 4001)
    assert score(star(50, 0), range(50)) == (1275, 42925)
    assert score(mesh(10), range(100)) == (1009, 10687)
    assert score(mesh(30), range(900)) == (27029, 828067)


def test_good_orders_are_good():
    g = mesh(24)
    base = score(g, range(g.n))[1]
    for name in ("amd", "amf", "nd", "fill", "multilevel"):
        assert score(g, ORDERS[name](g))[1] < 0.75 * base, name
    hub = star(200, 0)
    assert score(hub, minimum_degree(hub))[1] < score(hub, range(200))[1] / 50


def naive_fill(graph):
    near, alive, order = [set(x) for x in graph.neighbours], set(range(graph.n)), []
    while alive:
        lack = lambda v: sum(b not in near[a] for a in near[v] for b in near[v] if a < b)
        v = min(alive, key=lambda v: (lack(v), len(near[v]), v))
        order.append(v)
        alive.discard(v)
        for x in near[v]:
            near[x] = (near[x] | near[v]) - {v, x}
    return order


def test_minimum_fill_equals_full_scans():
    for seed in range(5):
        g = chance(40, 80, seed)
        assert orderings.minimum_fill(g) == naive_fill(g)


@pytest.mark.parametrize("budget", [0, 1, 200, 5000])
def test_spent_budgets_still_give_orders(budget):
    for graph in SHAPES.values():
        for make in (orderings.reverse_cuthill_mckee, orderings.sloan, minimum_degree, lambda g, budget: minimum_degree(g, fill=True, budget=budget), multilevel.multilevel_dissection):
            found = make(graph, budget=budget)
            assert is_order(found, graph.n) and found == make(graph, budget=budget)


def test_rules_for_ties():
    assert orderings.by_degree(path(4)) == [0, 3, 1, 2]
    assert orderings.reverse_cuthill_mckee(of(5, [(0, 1), (2, 3)])) == [4, 2, 3, 0, 1]
    assert orderings.reverse_cuthill_mckee(of(3, [])) == [2, 1, 0]


def test_leaves_go_first_and_add_nothing():
    tree = of(200, [(v, random.Random(v).randrange(v)) for v in range(1, 200)])
    for make in (lambda g: orderings.grown_dissection(g, 20), multilevel.multilevel_dissection, orderings.minimum_fill):
        assert score(path(100), make(path(100))) == (199, 397)
        assert score(tree, make(tree))[0] == 399
    assert orderings.leaves_first(of(6, [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4)])) == ([5, 4, 3], [0, 1, 2])


def test_components_are_ordered_by_themselves():
    two = of(800, [(2 * a, 2 * b) for a, row in enumerate(mesh(20).neighbours) for b in row] + [(2 * a + 1, 2 * b + 1) for a, row in enumerate(mesh(20).neighbours) for b in row])
    one = orderings.grown_dissection(mesh(20))
    assert orderings.by_components(two, orderings.grown_dissection) == [2 * v for v in one] + [2 * v + 1 for v in one]
    assert two.components() == [list(range(0, 800, 2)), list(range(1, 800, 2))]


def test_minimum_fill_of_larger_cores_goes_by_sets(monkeypatch):
    g = chance(60, 150, 8)
    by_bits = orderings.minimum_fill(g)
    monkeypatch.setattr(orderings, "BITS", 0)
    assert orderings.minimum_fill(g) == by_bits == naive_fill(g)


def test_minimum_fill_goes_on_to_the_last_vertex():
    """Full scans of this pattern come to more than 40 million pairs."""
    g = chance(600, 1800, 3)
    found = orderings.minimum_fill(g)
    assert is_order(found, 600) and found == orderings.minimum_fill(g, 10**12) != orderings.minimum_fill(g, 40_000_000)
    assert score(g, found)[1] < score(g, orderings.minimum_fill(g, 40_000_000))[1]
