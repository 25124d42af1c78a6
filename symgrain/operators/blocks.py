"""Factor columns counted block by block, so that no task holds a pattern.

An order's vertices are put into blocks of which edges join only a block with itself or with its
ancestors, and in which descendants go first: the parts and separators of a dissection, or just
connected components. A block's columns are then found from its own lists and from what its
descendants left over. Both are of one form, (first, members): a vertex's place with the later
places it is linked to, or a column's places that lie in ancestors. The first of a column's
places is its parent in the elimination tree and takes over the rest (Liu 1990, "The role of
elimination trees in sparse factorization"). Blocks of one depth are grouped tasks that run side
by side; what they leave is written, and goes up in a later round, deepest first, so there are as
many rounds as depths. A task holds one block's columns.

Places without edges are columns of their own; repeats and loops of edges count once and not at
all; a pattern without vertices has no columns; empty tables give none.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrain.operators.checkpoints import stored
from symgrain.operators.walks import components

_COLUMNS = "mid string, j long, parent long, c long, rest array<long>"


def by_components(edges: DataFrame, vertices: DataFrame, order: DataFrame) -> DataFrame:
    """An order (mid, k, v) with each vertex's component as its block, all of depth 0."""
    found = components(edges, vertices).select("mid", "v", F.col("component").alias("block"))
    return order.select("mid", "k", "v").join(found, ["mid", "v"]).withColumn("depth", F.lit(0))


def _eliminate(rows: pa.Table) -> pa.Table:
    """One block's columns; rows: mid, first, members, own (whether first is a place of this block that has not come otherwise)."""
    first, lists = rows.column("first").to_numpy(), rows.column("members").combine_chunks()
    ends, values = np.asarray(lists.offsets), np.asarray(lists.values)
    waiting: dict[int, list[np.ndarray]] = {}
    for j, a, b in zip(first.tolist(), ends[:-1], ends[1:], strict=True):
        waiting.setdefault(j, []).append(values[a:b])
    parents, counts, rests = [], [], []
    places = sorted(waiting)
    for j in places:
        below = np.unique(np.concatenate(waiting.pop(j)))
        counts.append(len(below) + 1)
        parents.append(int(below[0]) if len(below) else None)
        if len(below) and (at := waiting.get(int(below[0]))) is not None:
            at.append(below[1:])
            below = below[:0]
        rests.append(below[1:] if len(below) else None)
    mid = pa.array([rows.column("mid")[0].as_py()] * len(places), pa.string())
    return pa.table([mid, pa.array(places, pa.int64()), pa.array(parents, pa.int64()), pa.array(counts, pa.int64()), pa.array(rests, pa.list_(pa.int64()))], ["mid", "j", "parent", "c", "rest"])


def columns_by_blocks(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """(mid, j, parent, c) of each place j: its parent in the elimination tree, null for roots, and its column's entries. placed: (mid, k, v, block, depth) of every vertex."""
    at = stored(placed.select("mid", "v", "k", "block", "depth"), "placed")
    ends = lambda end: at.select("mid", F.col("v").alias(end), F.col("k").alias(f"{end}_at"))
    later = edges.select("mid", "a", "b").join(ends("a"), ["mid", "a"]).join(ends("b"), ["mid", "b"]).where("a_at < b_at")
    later = later.groupBy("mid", F.col("a_at").alias("k")).agg(F.collect_set("b_at").alias("members"))
    none = F.expr("cast(array() as array<bigint>)")
    where = at.select("mid", "k", "block", "depth")
    lists = stored(where.join(later, ["mid", "k"], "left").select("mid", "block", "depth", F.col("k").alias("first"), F.coalesce("members", none).alias("members")), "lists")
    left, done = [], []
    for depth in sorted((r["depth"] for r in lists.select("depth").distinct().collect()), reverse=True):
        now = reduce(DataFrame.unionByName, [x.where(F.col("depth") == depth) for x in (lists, *left)])
        found = stored(now.select("mid", "block", "first", "members").groupBy("mid", "block").applyInArrow(_eliminate, _COLUMNS), "columns")
        done.append(found.select("mid", "j", "parent", "c"))
        up = found.where("rest IS NOT NULL").select("mid", F.col("parent").alias("k"), F.col("rest").alias("members"))
        left.append(stored(up.join(where, ["mid", "k"]).select("mid", "block", "depth", F.col("k").alias("first"), "members"), "updates"))
    if not done:
        return at.select("mid", F.col("k").alias("j"), F.col("k").alias("parent"), F.col("k").alias("c"))
    return reduce(DataFrame.unionByName, done)


def scores_by_blocks(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """(mid, n, nnz_l, flops)."""
    return columns_by_blocks(edges, placed).groupBy("mid").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("nnz_l"), F.sum(F.col("c") * F.col("c")).alias("flops"))
