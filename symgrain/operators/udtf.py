"""Orders of one's own as SQL table functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from symgrain.functions.graph import Graph
from symgrain.functions.symbolic import is_order


def order_function(make: Callable[[Graph], list[int]]):
    """A table function of ``make`` (from a graph to its vertices in order).

    Takes a table (mid, a, b) with PARTITION BY mid and gives (mid, k, v) of each pattern: a row
    is an edge in either direction, or, where b is null, the vertex a. Vertices are those up to
    the highest number named; repeats, loops and negative numbers are dropped, rows without a are
    passed over, and rows without a mid are a pattern without a name. A result that is no order of
    the vertices fails the query. One pattern is one call, so it must fit a task.
    """

    class Order:
        def __init__(self):
            self.mid, self.ends, self.n = None, [], 0

        def eval(self, row):
            mid, a, b = row["mid"], row["a"], row["b"]
            self.mid = mid
            if a is not None:
                self.n = max(self.n, a + 1, -1 if b is None else b + 1)
                if b is not None:
                    self.ends.append((a, b))

        def terminate(self):
            order = make(Graph.edges(self.n, [a for a, _ in self.ends], [b for _, b in self.ends]))
            if not is_order(order, self.n):
                raise ValueError(f"{self.mid}: not an order of the vertices")
            for k, v in enumerate(order):
                yield self.mid, k, int(v)

    return udtf(Order, returnType="mid string, k bigint, v bigint")


def part_order_function(make: Callable[[Graph], list[int]]):
    """A table function of ``make`` for patterns that no task holds whole.

    Takes parts (mid, part, a, b), as ``symbolic.parts`` gives them, with PARTITION BY (mid,
    part), and gives (mid, component, vs) of each connected component: its least vertex, and its
    vertices in order. A result that is no order of them fails the query.
    """

    class Order:
        def __init__(self):
            self.mid, self.a, self.b = None, [], []

        def eval(self, row):
            self.mid = row["mid"]
            self.a.append(np.array(row["a"], np.int64))
            self.b.append(np.array(row["b"], np.int64))

        def terminate(self):
            if not self.a:
                return
            a, b = np.concatenate(self.a), np.concatenate(self.b)
            numbers, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            whole, vs = Graph.edges(len(numbers), place[: len(a)], place[len(a) :]), numbers.tolist()
            for component in whole.components():
                order = make(whole.within(component))
                if not is_order(order, len(component)):
                    raise ValueError(f"{self.mid}: not an order of the vertices")
                yield self.mid, vs[component[0]], [vs[component[k]] for k in order]

    return udtf(Order, returnType="mid string, component bigint, vs array<bigint>")


def register_part_order(spark: SparkSession, name: str, make: Callable[[Graph], list[int]]) -> None:
    """Makes ``SELECT * FROM name(TABLE(parts) PARTITION BY (mid, part))`` work in the session."""
    spark.udtf.register(name, part_order_function(make))


def register_order(spark: SparkSession, name: str, make: Callable[[Graph], list[int]]) -> None:
    """Makes ``SELECT * FROM name(TABLE(t) PARTITION BY mid)`` work in the session."""
    spark.udtf.register(name, order_function(make))


def entries(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The rows that an order function takes: each edge once, and each vertex."""
    return edges.where("a < b").select("mid", "a", "b").unionByName(vertices.select("mid", F.col("id").alias("a"), F.lit(None).cast("long").alias("b")))
