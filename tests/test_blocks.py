import random

import pytest
from pyspark.errors import PythonException

from symgrain.functions import orderings
from symgrain.functions.symbolic import column_counts, elimination_tree, reordered
from symgrain.operators import blocks, sweeps, symbolic, udtf
from symgrain.operators.numbering import numbered_by
from tests.test_sweeps import graph, graphs, loaded, orders, tables  # noqa: F401


def columns(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r["mid"], {})[r["j"]] = (-1 if r["parent"] is None else r["parent"], r["c"])
    return {mid: [at[j] for j in range(len(at))] for mid, at in out.items()}


def plain(order_of):
    out = {}
    for mid, g in graphs().items():
        moved = reordered(graph(*g), order_of[mid])
        out[mid] = list(zip(elimination_tree(moved), column_counts(moved), strict=True))
    return out


def test_dissected_columns_equal_the_kernel(loaded):  # noqa: F811
    placed = sweeps.dissected(*loaded, leaf=5).cache()
    assert placed.selectExpr("max(depth) AS d").first()["d"] >= 2  # what is left goes up more than once
    assert columns(blocks.columns_by_blocks(loaded[0], placed)) == plain(orders(placed))


def test_components_of_any_order_equal_the_kernel(spark, loaded):  # noqa: F811
    rng, shuffled = random.Random(6), {}
    for mid, (n, _) in graphs().items():
        shuffled[mid] = rng.sample(range(n), n)
    order = spark.createDataFrame([(mid, k, v) for mid, vs in shuffled.items() for k, v in enumerate(vs)], "mid string, k long, v long")
    placed = blocks.by_components(*loaded, order)
    want = plain(shuffled)
    assert columns(blocks.columns_by_blocks(loaded[0], placed)) == want
    scores = {r["mid"]: (r["n"], r["nnz_l"], r["flops"]) for r in blocks.scores_by_blocks(loaded[0], placed).collect()}
    assert scores == {mid: (len(c), sum(x for _, x in c), sum(x * x for _, x in c)) for mid, c in want.items()}


def test_no_blocks(spark):
    placed = spark.createDataFrame([], "mid string, k long, v long, block long, depth int")
    assert blocks.columns_by_blocks(spark.createDataFrame([], "mid string, a long, b long"), placed).count() == 0


def test_order_functions(spark):
    some = graphs()
    udtf.register_order(spark, "slimmest_first", orderings.by_degree)
    udtf.entries(*tables(spark, some)).createOrReplaceTempView("entries_of_some")
    found = orders(spark.sql("SELECT * FROM slimmest_first(TABLE(entries_of_some) PARTITION BY mid)"))
    assert found == {mid: orderings.by_degree(graph(*g)) for mid, g in some.items()}
    odd = spark.createDataFrame([(None, 0, 2), (None, 2, 2), (None, None, 1), ("x", 1, None), ("x", -5, 0)], "mid string, a long, b long")
    assert sorted(map(tuple, spark.sql("SELECT * FROM slimmest_first(TABLE({odd}) PARTITION BY mid)", odd=odd).collect()), key=str) == [("x", 0, 0), ("x", 1, 1), (None, 0, 1), (None, 1, 0), (None, 2, 2)]
    udtf.register_order(spark, "no_order", lambda g: [0] * g.n)
    with pytest.raises(PythonException, match="not an order"):
        spark.sql("SELECT * FROM no_order(TABLE(entries_of_some) PARTITION BY mid)").collect()


def test_orders_of_parts(spark):
    """Reverse Cuthill-McKee component by component gives the places of whole patterns."""
    some = graphs()
    udtf.register_part_order(spark, "rcm_of_parts", orderings.reverse_cuthill_mckee)
    for at_once in (1, 1000):
        parts = symbolic.parts(*tables(spark, some), at_once)
        found = spark.sql("SELECT mid, -component AS place, posexplode(vs) AS (at, v) FROM rcm_of_parts(TABLE({parts}) PARTITION BY (mid, part))", parts=parts)
        assert orders(numbered_by(found, "mid", ["place", "at"], "k")) == {mid: orderings.reverse_cuthill_mckee(graph(*g)) for mid, g in some.items() if g[0]}
    udtf.register_part_order(spark, "no_part_order", lambda g: [0] * (g.n + 1))
    with pytest.raises(PythonException, match="not an order"):
        spark.sql("SELECT * FROM no_part_order(TABLE({parts}) PARTITION BY (mid, part))", parts=parts).collect()


def test_blocks_of_a_dissection_by_tasks_are_components(spark):
    some = {"copies": (72, [(a + 9 * i, b + 9 * i) for i in range(8) for a, b in ((0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8), (0, 4), (2, 7))])}
    edges, vertices = tables(spark, some)
    placed = sweeps.dissected(edges, vertices, leaf=4, within=12).cache()
    assert placed.groupBy("block").agg({"v": "count"}).where("`count(v)` <> 9").isEmpty()
    moved = reordered(graph(*some["copies"]), orders(placed)["copies"])
    assert columns(blocks.columns_by_blocks(edges, placed))["copies"] == list(zip(elimination_tree(moved), column_counts(moved), strict=True))
