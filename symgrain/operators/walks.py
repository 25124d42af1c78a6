"""Graph steps as joins: levels, components, medians, borders, gains, lacking links."""

from __future__ import annotations

from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symgrain.functions.sweeping import labels
from symgrain.operators.checkpoints import stored

#: Levels after which those behind are put into one table.
LEVELS_AT_ONCE = 24
#: Links of a pattern that one task joins up at once.
CHUNK = 2_000_000


def levels(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(mid, v, level): breadth-first distance from starts (mid, v); what is not reached is left out. A round per level, all patterns at once."""
    step = stored(edges.select("mid", F.col("a").alias("v"), F.col("b").alias("to")), "steps")
    front = stored(starts.select("mid", "v", F.lit(0).cast("long").alias("level")).distinct(), "levels")
    behind, found = front.limit(0), [front]
    for k in count(1):
        ahead = front.join(step, ["mid", "v"]).select("mid", F.col("to").alias("v")).distinct()
        # A neighbour of a level lies in it, before or behind it.
        fresh = ahead.join(front.select("mid", "v").unionByName(behind.select("mid", "v")), ["mid", "v"], "left_anti")
        behind, front = front, stored(fresh.withColumn("level", F.lit(k).cast("long")), "levels")
        if front.isEmpty():
            return stored(reduce(DataFrame.unionByName, found), "levels")
        if k % LEVELS_AT_ONCE == 0:
            found = [stored(reduce(DataFrame.unionByName, found), "levels")]
        found.append(front)


def _chunk_labels(rows: pa.Table) -> pa.Table:
    """(mid, v, label) of each vertex of one chunk of a pattern's links (mid, a, b): the least vertex that these links reach."""
    ids, at = np.unique(np.concatenate([rows.column(end).to_numpy() for end in ("a", "b")]), return_inverse=True)
    label = labels(at[: rows.num_rows], at[rows.num_rows :], len(ids))
    return pa.table([pa.repeat(rows.column("mid")[0], len(ids)), pa.array(ids), pa.array(ids[label])], ["mid", "v", "label"])


def _spread(half: DataFrame, max_rounds: int) -> DataFrame:
    """(mid, v, component) by labels that spread to neighbours, then jump to their labels' labels."""
    edges = stored(half.unionByName(half.select("mid", F.col("b").alias("a"), F.col("a").alias("b"))), "spread")
    known = stored(edges.select("mid", F.col("a").alias("v"), F.col("a").alias("component")).distinct(), "spread")
    for _ in range(max_rounds):
        near = edges.select("mid", F.col("b").alias("v"), F.col("a").alias("u")).join(known.select("mid", F.col("v").alias("u"), "component"), ["mid", "u"]).select("mid", "v", "component")
        least = known.unionByName(near).groupBy("mid", "v").agg(F.min("component").alias("component"))
        jump = least.select("mid", F.col("v").alias("component"), F.col("component").alias("further"))
        new = stored(least.join(jump, ["mid", "component"]).select("mid", "v", F.col("further").alias("component")), "spread")
        if new.join(known, ["mid", "v", "component"], "left_anti").isEmpty():
            return known
        known = new
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


def linked_components(half: DataFrame, max_rounds: int = 100, chunk: int = CHUNK) -> DataFrame:
    """(mid, v, component) of every vertex with a link: the least vertex that can be reached; half: (mid, a, b), each link once.

    Links are dealt into chunks of one pattern, by their first ends where a pattern has more than
    ``chunk``, and each is labelled by itself. Vertices that lie in several chunks link their
    labels; these fewer links are joined up in the same way, or, once chunks no longer halve
    them, by labels that spread.
    """
    parts = half.groupBy("mid").agg(F.expr(f"count(1) div {chunk} + 1").alias("parts"))
    dealt = half.select("mid", "a", "b").join(parts, "mid").withColumn("part", F.expr("pmod(xxhash64(a), parts)"))
    found = stored(dealt.select("mid", "part", "a", "b").groupBy("mid", "part").applyInArrow(_chunk_labels, "mid string, v long, label long"), "labels")
    if parts.where("parts > 1").isEmpty():
        return found.withColumnRenamed("label", "component")
    each = stored(found.groupBy("mid", "v").agg(F.min("label").alias("low"), F.collect_set("label").alias("labels")), "labels")
    crossing = each.where("size(labels) > 1").select("mid", F.col("low").alias("a"), F.explode("labels").alias("b")).where("a <> b").distinct()
    crossing = stored(crossing, "crossing")
    if crossing.isEmpty():
        return each.select("mid", "v", F.col("low").alias("component"))
    fewer = crossing.count() * 2 <= half.count()
    upper = (linked_components(crossing, max_rounds, chunk) if fewer else _spread(crossing, max_rounds)).withColumnRenamed("v", "low")
    return stored(each.join(upper, ["mid", "low"], "left").select("mid", "v", F.coalesce("component", "low").alias("component")), "labels")


def binned(half: DataFrame, at_once: int) -> DataFrame:
    """(mid, v, component, bin) of every vertex with a link: connected components of some ``at_once`` links of a pattern have a bin together, a larger one a bin mostly to itself; half: (mid, a, b), each link once."""
    bins = half.groupBy("mid").agg(F.expr(f"count(1) div {at_once} + 1").alias("bins"))
    return linked_components(half).join(bins, "mid").select("mid", "v", "component", F.expr("pmod(xxhash64(component), bins)").alias("bin"))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by the hash of keys over all shuffle partitions: groups of kernels, few rows that take long, are not put together again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def components(edges: DataFrame, vertices: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(mid, v, component): the least vertex that can be reached."""
    found = linked_components(edges.where("a < b"), max_rounds)
    return vertices.select("mid", F.col("id").alias("v")).join(found, ["mid", "v"], "left").select("mid", "v", F.coalesce("component", "v").alias("component"))


def median_level(leveled: DataFrame) -> DataFrame:
    """(mid, reached, median): the first level up to which half of the reached vertices lie."""
    counts = leveled.groupBy("mid", "level").agg(F.count(F.lit(1)).alias("size"))
    upto, whole = F.sum("size").over(W.partitionBy("mid").orderBy("level")), F.sum("size").over(W.partitionBy("mid"))
    return counts.select("mid", "level", upto.alias("upto"), whole.alias("reached")).groupBy("mid").agg(F.max("reached").alias("reached"), F.min(F.when(F.expr("upto >= (reached + 1) div 2"), F.col("level"))).alias("median"))


def border(edges: DataFrame, sides: DataFrame) -> DataFrame:
    """(mid, v, side) of vertices with a neighbour on the other side; sides: (mid, v, side boolean)."""
    crossing = edges.join(sides.select("mid", F.col("v").alias("b"), F.col("side").alias("there")), ["mid", "b"]).select("mid", F.col("a").alias("v"), F.col("there").alias("other"))
    return sides.join(crossing, (sides["mid"] == crossing["mid"]) & (sides["v"] == crossing["v"]) & (sides["side"] != crossing["other"]), "left_semi")


def gains(edges: DataFrame, sides: DataFrame) -> DataFrame:
    """(mid, v, gain): twice the neighbours within the half (side true), less all neighbours in the subset."""
    near = edges.join(sides.select("mid", F.col("v").alias("b"), "side"), ["mid", "b"]).groupBy("mid", F.col("a").alias("v")).agg(F.sum(F.when(F.col("side"), 1).otherwise(-1)).alias("gain"))
    return sides.select("mid", "v").join(near, ["mid", "v"], "left").select("mid", "v", F.coalesce("gain", F.lit(0)).alias("gain"))


def lacks(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mid, v, degree, lack): pairs of neighbours that are not linked = all pairs less the triangles at v. Triangles are found from the lower-degree ends, so a hub's pairs are never listed."""
    degree = edges.groupBy("mid", "a").agg(F.count(F.lit(1)).alias("d"))
    rank = lambda end: degree.select("mid", F.col("a").alias(end), F.struct("d", F.col("a").alias("v")).alias(f"{end}_rank"))
    up = edges.where("a <> b").join(rank("a"), ["mid", "a"]).join(rank("b"), ["mid", "b"]).where("a_rank < b_rank").select("mid", "a", "b", "b_rank")
    fans = up.select("mid", "a", F.col("b").alias("x"), F.col("b_rank").alias("x_rank")).join(up.select("mid", "a", F.col("b").alias("y"), F.col("b_rank").alias("y_rank")), ["mid", "a"]).where("x_rank < y_rank")
    triangles = fans.join(up.select("mid", F.col("a").alias("x"), F.col("b").alias("y")), ["mid", "x", "y"], "left_semi")
    closed = triangles.select("mid", F.explode(F.array("a", "x", "y")).alias("v")).groupBy("mid", "v").agg(F.count(F.lit(1)).alias("closed"))
    every = vertices.select("mid", F.col("id").alias("v")).join(degree.withColumnRenamed("a", "v"), ["mid", "v"], "left").join(closed, ["mid", "v"], "left")
    d = F.coalesce("d", F.lit(0))
    return every.select("mid", "v", d.cast("long").alias("degree"), (F.expr("coalesce(d, 0) * (coalesce(d, 0) - 1) div 2") - F.coalesce("closed", F.lit(0))).cast("long").alias("lack"))


def first_pivot(lacking: DataFrame) -> DataFrame:
    """The vertex that minimum fill eliminates first: least lack, then degree, then number."""
    pick = F.min(F.struct("lack", "degree", "v"))
    return lacking.groupBy("mid").agg(pick.alias("p")).select("mid", "p.v", "p.degree", "p.lack")
