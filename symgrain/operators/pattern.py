"""Sparse symmetric patterns as tables.

Edges: (mid, a, b), both directions, no loops, no repeats. Packed: one row per pattern, (mid, n,
col_at array<long>, rows array<long>): column j's rows are rows[col_at[j] : col_at[j + 1]].
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Columns, or rows, of a piece of a packed pattern.
PIECE_CELLS = 256


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, without loops and repeats."""
    both = edges.select("mid", "a", "b").unionByName(edges.select("mid", F.col("b").alias("a"), F.col("a").alias("b")))
    return both.where("a <> b").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Both directions of edges that are given once each, without loops; needs no shuffle."""
    return edges.select("mid", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("mid", "e.a", "e.b")


def out_of_range(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Edges with an end that is no vertex of the pattern; sizes: (mid, n)."""
    return edges.join(sizes, "mid").where("a < 0 OR b < 0 OR a >= n OR b >= n").select("mid", "a", "b", "n")


def upper(edges: DataFrame) -> DataFrame:
    """Each edge once, the lower end first."""
    return edges.where("a < b")


def degrees(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mid, v, degree), zero for isolated vertices; vertices: (mid, id)."""
    found = edges.groupBy("mid", F.col("a").alias("v")).agg(F.count(F.lit(1)).alias("degree"))
    return vertices.select("mid", F.col("id").alias("v")).join(found, ["mid", "v"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def matrices(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mid, n, nnz, density, max_degree); density: whole entries per column."""
    each = degrees(edges, vertices).groupBy("mid").agg(F.count(F.lit(1)).alias("n"), F.sum("degree").alias("nnz"), F.max("degree").alias("max_degree"))
    return each.select("mid", "n", "nnz", F.expr("nnz div greatest(n, 1)").alias("density"), "max_degree")


def columns_of(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mid, col, rows, col_end): each column's sorted rows, and where the next column begins."""
    lists = edges.groupBy("mid", F.col("a").alias("col")).agg(F.sort_array(F.collect_list("b")).alias("rows"))
    every = vertices.select("mid", F.col("id").alias("col")).join(lists, ["mid", "col"], "left").withColumn("rows", F.coalesce("rows", F.expr("cast(array() as array<bigint>)")))
    return every.withColumn("col_end", F.sum(F.size("rows").cast("long")).over(W.partitionBy("mid").orderBy("col")))


def pack(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Packed patterns. One group is one pattern, which a kernel must hold anyway."""
    grouped = columns_of(edges, vertices).groupBy("mid").agg(F.sort_array(F.collect_list(F.struct("col", "rows", "col_end"))).alias("cols"))
    return grouped.select("mid", F.size("cols").cast("long").alias("n"), F.concat(F.array(F.lit(0).cast("long")), F.col("cols.col_end")).alias("col_at"), F.flatten("cols.rows").alias("rows"))


def pieces(edges: DataFrame, vertices: DataFrame, cells: int = PIECE_CELLS) -> DataFrame:
    """Packed patterns in pieces: (mid, n, col, col_at, rows): of some columns from col on, their starts and the end of the last, and their rows. A piece has some ``cells`` columns or rows at most, or one column."""
    each = columns_of(edges, vertices).withColumn("start", F.col("col_end") - F.size("rows"))
    grouped = each.groupBy("mid", F.expr(f"start div {cells}").alias("by_rows"), F.expr(f"col div {cells}").alias("by_columns")).agg(F.sort_array(F.collect_list(F.struct("col", "start", "rows", "col_end"))).alias("cols"))
    sizes = vertices.groupBy("mid").agg(F.count(F.lit(1)).alias("n"))
    first = F.col("cols")[0]
    return grouped.join(sizes, "mid").select("mid", "n", first["col"].alias("col"), F.concat(F.array(first["start"]), F.col("cols.col_end")).alias("col_at"), F.flatten("cols.rows").alias("rows"))


def unpack_pieces(packed: DataFrame) -> DataFrame:
    """Edges of packed patterns in pieces; loops are dropped."""
    own = packed.where("size(col_at) > 1").withColumn("col_at", F.transform("col_at", lambda x: x - F.col("col_at")[0]))
    each = own.select("mid", "col", "col_at", "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.size("col_at").cast("long") - 2)).alias("j"))
    return each.select("mid", (F.col("col") + F.col("j")).alias("a"), F.explode(column(F.col("col_at"), F.col("rows"), F.col("j"))).alias("b")).where("a <> b")


def column(packed_at: Column, packed_rows: Column, j: Column) -> Column:
    """The rows of column j."""
    start, stop = F.get(packed_at, j.cast("int")), F.get(packed_at, (j + 1).cast("int"))
    return F.slice(packed_rows, (start + 1).cast("int"), (stop - start).cast("int"))


def entries() -> Column:
    """A packed pattern's entries off the diagonal, of its columns n, col_at, rows."""
    return F.expr("cast(size(rows) - if(n > 0, size(filter(sequence(0L, n - 1), j -> array_contains(slice(rows, cast(get(col_at, cast(j as int)) as int) + 1, cast(get(col_at, cast(j as int) + 1) - get(col_at, cast(j as int)) as int)), j))), 0) as long)")


def unpack(packed: DataFrame) -> DataFrame:
    """Edges of packed patterns; loops are dropped."""
    each = packed.where("n > 0").select("mid", "col_at", "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("a"))
    return each.select("mid", "a", F.explode(column(F.col("col_at"), F.col("rows"), F.col("a"))).alias("b")).where("a <> b")


def faults(packed: DataFrame) -> DataFrame:
    """Adds ``fault``: the first thing wrong with a packed pattern, or null."""
    n, at, rows = F.col("n"), F.col("col_at"), F.col("rows")
    falls = F.exists(F.zip_with(F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda x, y: y < x), lambda x: x)
    return packed.withColumn(
        "fault",
        F.when(n.isNull(), "n missing").when(at.isNull(), "col_at missing").when(rows.isNull(), "rows missing")
        .when(F.size(at) != n + 1, "col_at length").when(F.get(at, F.lit(0)) != 0, "col_at start")
        .when(F.get(at, F.size(at) - 1) != F.size(rows), "col_at end").when(falls, "col_at falls")
        .when(F.exists(rows, lambda x: x.isNull() | (x < 0) | (x >= n)), "row out of range"),
    )


def asymmetric(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is missing."""
    return edges.join(edges.select("mid", F.col("b").alias("a"), F.col("a").alias("b")), ["mid", "a", "b"], "left_anti")
