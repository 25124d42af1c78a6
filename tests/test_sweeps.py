import random

import pytest

from symgrain.functions import orderings
from symgrain.functions.graph import Graph
from symgrain.functions.symbolic import is_order
from symgrain.operators import pattern, sweeps


def mesh(k):
    return k * k, [(i, j) for i in range(k * k) for j in (i + 1, i + k) if j < k * k and (j != i + 1 or j % k)]


def graphs():
    rng = random.Random(4)
    out = {"mesh": mesh(5), "one": (1, []), "loose": (9, []), "arrow": (25, [(0, i) for i in range(1, 25)]), "paths": (18, [(i, i + 1) for i in range(17) if i != 8]), "complete": (12, [(i, j) for i in range(12) for j in range(i)])}
    for k in range(3):
        n = rng.randint(5, 45)
        out[f"random {k}"] = n, [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 3 * n))]
    return out


def tables(spark, some):
    rows = [(mid, a, b) for mid, (_, pairs) in some.items() for a, b in pairs]
    vertices = [(mid, i) for mid, (n, _) in some.items() for i in range(n)]
    return pattern.symmetrize(spark.createDataFrame(rows, "mid string, a long, b long")), spark.createDataFrame(vertices, "mid string, id long")


def graph(n, pairs):
    return Graph.edges(n, [a for a, _ in pairs], [b for _, b in pairs])


def orders(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r["mid"], {})[r["k"]] = r["v"]
    return {mid: [at[k] for k in range(len(at))] for mid, at in out.items()}


@pytest.fixture(scope="module")
def loaded(spark):
    edges, vertices = tables(spark, graphs())
    return edges.cache(), vertices.cache()


def test_nested_dissection_equals_the_kernel(loaded):
    found = orders(sweeps.nested_dissection(*loaded, leaf=5))
    assert found == {mid: orderings.nested_dissection(graph(*g), leaf=5) for mid, g in graphs().items()}


def test_cuthill_mckee_equals_the_kernel(loaded):
    found = orders(sweeps.cuthill_mckee(*loaded))
    assert found == {mid: orderings.reverse_cuthill_mckee(graph(*g)) for mid, g in graphs().items()}


def test_sweeps_discover_as_a_queue_does(spark, loaded, monkeypatch):
    monkeypatch.setattr(sweeps, "LEVELS_AT_ONCE", 3)
    edges, _ = loaded
    starts = spark.createDataFrame([("mesh", 3, 3), ("paths", 5, 5), ("paths", 14, 14)], "mid string, part long, v long")
    steps = edges.selectExpr("mid", "a AS v", "b AS to", "0L AS rank")
    rows = sweeps.sweep(steps, starts).collect()
    for mid, part in (("mesh", 3), ("paths", 5), ("paths", 14)):
        mine = sorted((r["level"], r["key"], r["v"]) for r in rows if (r["mid"], r["part"]) == (mid, part))
        levels = graph(*graphs()[mid]).walk(part)
        assert [v for *_, v in mine] == [v for level in levels for v in level]
        assert [k for k, *_ in mine] == [k for k, level in enumerate(levels) for _ in level]


def test_no_patterns(spark):
    edges, vertices = spark.createDataFrame([], "mid string, a long, b long"), spark.createDataFrame([], "mid string, id long")
    assert sweeps.nested_dissection(edges, vertices).count() == sweeps.cuthill_mckee(edges, vertices).count() == 0


def test_overdrawn_budget_fills_what_is_left(spark, monkeypatch):
    some = {"dust": (60, [(i, i + 1) for i in range(0, 60, 2)])}
    monkeypatch.setattr(sweeps, "BUDGET", (1, 0))
    found = orders(sweeps.nested_dissection(*tables(spark, some), leaf=2))["dust"]
    assert is_order(found, 60)


@pytest.mark.parametrize("within, budget", [(12, (64, 4096)), (10**6, (3, 0))])
def test_parts_taken_whole_give_the_same_places(spark, monkeypatch, within, budget):
    some = {"mesh": mesh(5), "dust": (20, [(i, i + 1) for i in range(0, 20, 2)]), "random": graphs()["random 2"]}
    monkeypatch.setattr(sweeps, "BUDGET", budget)
    edges, vertices = tables(spark, some)
    found = orders(sweeps.nested_dissection(edges, vertices, leaf=2, within=within))
    assert found == _round_by_round(some, 2, budget)
    if budget[1]:
        assert orders(sweeps.cuthill_mckee(edges, vertices, within=within)) == {mid: orderings.reverse_cuthill_mckee(graph(*g)) for mid, g in some.items()}


def _round_by_round(some, leaf, budget):
    out = {}
    for mid, g in some.items():
        whole, placed, left = graph(*g), [], budget[0] * g[0] + budget[1]
        parts = [(0, list(range(g[0])))]
        while parts:
            following, able = [], left >= 0
            for first, part in parts:
                if len(part) <= leaf or not able:
                    placed += [(first, whole.degree[v], v) for v in part]
                    continue
                left -= len(part)
                levels = whole.walk(orderings._outer_seed(whole, part, set(part)), set(part).__contains__)
                half = (sum(map(len, levels)) + 1) // 2
                median = next(k for k in range(len(levels)) if sum(map(len, levels[: k + 1])) >= half)
                below = [v for level in levels[:median] for v in level]
                above = [v for v in part if v not in {*below, *levels[median]}]
                if not below and not above:
                    placed += [(first, whole.degree[v], v) for v in part]
                else:
                    placed += [(first + len(part) - len(levels[median]), 0, v) for v in levels[median]]
                following += [(at, p) for at, p in ((first, sorted(below)), (first + len(below), above)) if p]
            parts = following
        out[mid] = [v for *_, v in sorted(placed)]
    return out


def test_a_part_that_fits_a_task_takes_one_round(spark):
    some = {"dust": (60, [(i, i + 1) for i in range(0, 60, 2)])}  # one component a round by tables
    placed = sweeps.dissected(*tables(spark, some), leaf=2, within=1000)
    assert placed.selectExpr("max(depth) AS d").first()["d"] == 0


def test_orders_and_component_scores_hold_no_pattern_in_a_row(spark, monkeypatch):
    from symgrain import catalogue

    def never(*_):
        raise AssertionError("a whole pattern, or a group for each component")

    monkeypatch.setattr(catalogue.pattern, "pack", never)
    monkeypatch.setattr(catalogue.blocks, "columns_by_blocks", never)
    for name in ("order_nd", "order_rcm", "score_components"):
        assert not catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").isEmpty()


@pytest.mark.parametrize("budget", [(64, 4096), (4, 0)])
def test_components_that_fit_tasks_take_one_round_together(spark, monkeypatch, budget):
    """Copies of a pattern that do not touch, together of more links than a task takes; by tables one is split a round."""
    rng, copies = random.Random(9), 8
    one = [(rng.randrange(12), 12 + rng.randrange(18)) for _ in range(40)]
    some = {"copies": (30 * copies, [(a + 30 * i, b + 30 * i) for i in range(copies) for a, b in one])}
    monkeypatch.setattr(sweeps, "BUDGET", budget)
    placed = sweeps.dissected(*tables(spark, some), leaf=4, within=50).cache()
    assert placed.selectExpr("max(depth) AS d").first()["d"] == 0
    assert orders(placed) == _round_by_round(some, 4, budget)


def test_all_components_of_a_bin_are_swept_at_once():
    import numpy as np

    from symgrain.functions import sweeping

    for n, pairs in graphs().values():
        links = sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]})
        a, b = (np.array([p[k] for p in links], np.int64) for k in (0, 1))
        at, near = sweeping.links_of(a, b, n)
        component = np.unique(sweeping.labels(a, b, n), return_inverse=True)[1]
        found = sweeping.cuthill_mckee(at, near, np.diff(at), component)
        assert found[::-1].tolist() == orderings.reverse_cuthill_mckee(graph(n, pairs))
