"""Scores of elimination orders.

Orders: (mid, candidate, k, v): vertex v goes k-th. ``permute`` relabels edges by two joins. For
scores the edges of a pattern's connected components, whose columns do not depend on each other,
are gathered once, whatever the number of orders, and relabelled by the kernel, one call per some
components and order, which returns integers only: a task holds a component, not a pattern. The relational
twin counts by the fill-path theorem and serves as an independent check on shallow patterns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrain.functions.graph import Graph
from symgrain.functions.symbolic import column_counts, elimination_tree
from symgrain.operators.checkpoints import cut, stored
from symgrain.operators.numbering import numbered_by
from symgrain.operators.walks import binned, dealt

#: Links of a pattern's components that a kernel takes at once; a component with more goes by itself.
LINKS_AT_ONCE = 100_000
#: The same where a kernel orders them, which takes far longer.
PART_LINKS = 20_000
#: Links of a row of a part.
PIECE_LINKS = 2_000


_COLUMNS = pa.schema([("mid", pa.string()), ("candidate", pa.string()), *[(c, pa.int64()) for c in ("j", "parent", "c")]])
_SCORES = pa.schema([("mid", pa.string()), ("candidate", pa.string()), *[(c, pa.int64()) for c in ("n", "nnz_l", "flops")]])


def natural_order(vertices: DataFrame) -> DataFrame:
    return vertices.select("mid", F.lit("natural").alias("candidate"), F.col("id").alias("k"), F.col("id").alias("v"))


def reverse_order(vertices: DataFrame) -> DataFrame:
    """The highest number first."""
    sizes = vertices.groupBy("mid").agg(F.count(F.lit(1)).alias("n"))
    return vertices.join(sizes, "mid").select("mid", F.lit("reverse").alias("candidate"), (F.col("n") - 1 - F.col("id")).alias("k"), F.col("id").alias("v"))


def degree_order(degrees: DataFrame) -> DataFrame:
    """By (degree, number); degrees: (mid, v, degree)."""
    return numbered_by(degrees, "mid", ["degree", "v"], "k").select("mid", F.lit("degree").alias("candidate"), "k", "v")


def permute(edges: DataFrame, orders: DataFrame) -> DataFrame:
    """(mid, candidate, a, b): both ends renamed to their places in each order."""
    at = lambda end: orders.select("mid", "candidate", F.col("v").alias(end), F.col("k").alias(f"{end}_at"))
    moved = edges.join(at("a"), ["mid", "a"]).join(at("b"), ["mid", "candidate", "b"])
    return moved.select("mid", "candidate", F.col("a_at").alias("a"), F.col("b_at").alias("b"))


def _binned(edges: DataFrame, at_once: int) -> tuple[DataFrame, DataFrame]:
    """(mid, v, component, bin) of each vertex with a link, connected components of some ``at_once`` links having a bin together; and (mid, bin, a, b): each link."""
    half = stored(edges.where("a < b").select("mid", "a", "b"), "half")
    found = stored(binned(half, at_once), "bins")
    return found, half.join(found.select("mid", F.col("v").alias("a"), "bin"), ["mid", "a"]).select("mid", "bin", "a", "b")


def parts(edges: DataFrame, vertices: DataFrame, at_once: int = PART_LINKS) -> DataFrame:
    """(mid, part, a, b): connected components of a pattern, some ``at_once`` links together, in rows of some ``PIECE_LINKS`` links; a vertex without links is a loop. A larger component is a part by itself. No row grows with a part; kernels take one part's rows at a time, grouped."""
    found, links = _binned(edges, at_once)
    # Vertices without links go anywhere.
    alone = vertices.select("mid", F.col("id").alias("a")).join(found.select("mid", F.col("v").alias("a")), ["mid", "a"], "left_anti").select("mid", F.expr(f"a div {at_once}").alias("bin"), "a", F.col("a").alias("b"))
    pieces = F.expr(f"pmod(xxhash64(a), {at_once // PIECE_LINKS + 1})")
    each = links.unionByName(alone).groupBy("mid", F.col("bin").alias("part"), pieces.alias("piece")).agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    return each.select("mid", "part", "a", "b")


def part_of(rows: pa.Table) -> tuple[np.ndarray, Graph]:
    """The vertices, ascending, and the pattern of all rows (a, b) of a part."""
    a, b = (np.concatenate([np.asarray(x.flatten()) for x in rows.column(c).chunks]) for c in ("a", "b"))
    vs, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    return vs, Graph.edges(len(vs), place[: len(a)], place[len(a) :])


def _groups(edges: DataFrame, orders: DataFrame) -> DataFrame:
    """Rows (mid, bin, candidate, x, y) of connected components of a pattern, some ``LINKS_AT_ONCE`` links together: their vertices' places and numbers in each order, and, without candidate, their links."""
    found, links = _binned(edges, LINKS_AT_ONCE)
    # Vertices without links go anywhere.
    placed = orders.join(found, ["mid", "v"], "left").withColumn("bin", F.coalesce("bin", F.expr(f"v div {LINKS_AT_ONCE}")))
    placed = placed.select("mid", "bin", "candidate", F.col("k").alias("x"), F.col("v").alias("y"))
    return dealt(placed.unionByName(links.select("mid", "bin", F.lit(None).cast("string").alias("candidate"), F.col("a").alias("x"), F.col("b").alias("y"))), "mid", "bin")


def _reordered(rows: pa.Table):
    """(candidate, places, graph) of each order of a group: its vertices' places, ascending, and the pattern with the vertex at places[k] named k; links with a vertex that the order lacks are left out."""
    names = rows.column("candidate").combine_chunks().dictionary_encode()
    x, y = rows.column("x").to_numpy(), rows.column("y").to_numpy()
    number = names.indices.fill_null(-1).to_numpy()
    a, b = x[number < 0], y[number < 0]
    for index, candidate in enumerate(names.dictionary):
        places, order = x[number == index], y[number == index]
        by_number, by_place = np.argsort(order), np.argsort(places)
        rank = np.empty(len(places), np.int64)
        rank[by_place] = np.arange(len(places))
        numbers = order[by_number]

        def place(v, numbers=numbers, at=rank[by_number]):
            found = np.minimum(np.searchsorted(numbers, v), len(numbers) - 1)
            return np.where(numbers[found] == v, at[found], -1)

        yield candidate, places[by_place], Graph.edges(len(places), place(a), place(b))


def columns(edges: DataFrame, orders: DataFrame) -> DataFrame:
    """(mid, candidate, j, parent, c): parent in the elimination tree, null for roots, and the factor column's entries."""

    def run(rows: pa.Table) -> pa.Table:
        out = []
        for candidate, places, graph in _reordered(rows):
            parent = elimination_tree(graph)
            counts = column_counts(graph, parent)
            up = np.asarray(parent, np.int64)
            out.append(pa.table([pa.repeat(rows.column("mid")[0], graph.n), pa.repeat(candidate, graph.n), pa.array(places), pa.array(places[up], mask=up < 0), pa.array(counts, pa.int64())], ["mid", "candidate", "j", "parent", "c"]))
        return pa.concat_tables(out) if out else _COLUMNS.empty_table()

    return _groups(edges, orders).groupBy("mid", "bin").applyInArrow(run, "mid string, candidate string, j long, parent long, c long")


def scores(edges: DataFrame, orders: DataFrame) -> DataFrame:
    """(mid, candidate, n, nnz_l, flops)."""

    def run(rows: pa.Table) -> pa.Table:
        out = []
        for candidate, _, graph in _reordered(rows):
            counts = column_counts(graph)
            out.append((rows.column("mid")[0].as_py(), candidate.as_py(), len(counts), sum(counts), sum(c * c for c in counts)))
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out, strict=True), _SCORES.types, strict=True)], _SCORES.names) if out else _SCORES.empty_table()

    each = stored(_groups(edges, orders).groupBy("mid", "bin").applyInArrow(run, "mid string, candidate string, n long, nnz_l long, flops long"), "scores")
    return each.groupBy("mid", "candidate").agg(*[F.sum(c).alias(c) for c in ("n", "nnz_l", "flops")])


def columns_by_paths(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mid, j, parent, c) in natural order without a kernel: column j has row i > j iff a path j..i leads over vertices below j alone (Rose, Tarjan and Lueker 1976).

    Reached pairs grow by one step a round, all patterns at once, until none is new; the loop is
    as long as the longest such path, so this is for shallow patterns.
    """
    step = edges.select("mid", F.col("a").alias("at"), F.col("b").alias("to"))
    reached = cut(edges.select("mid", F.col("a").alias("j"), F.col("b").alias("v")))
    fresh = reached
    while True:
        ahead = fresh.where("v < j").withColumnRenamed("v", "at").join(step, ["mid", "at"]).select("mid", "j", F.col("to").alias("v")).where("v <> j").distinct()
        fresh = cut(ahead.join(reached, ["mid", "j", "v"], "left_anti"))
        if fresh.isEmpty():
            break
        reached = cut(reached.unionByName(fresh))
    above = reached.where("v > j").groupBy("mid", "j").agg(F.min("v").alias("parent"), F.count(F.lit(1)).alias("c"))
    return vertices.select("mid", F.col("id").alias("j")).join(above, ["mid", "j"], "left").select("mid", "j", "parent", (F.coalesce("c", F.lit(0)) + 1).cast("long").alias("c"))
