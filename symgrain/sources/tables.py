"""Patterns out of relational tables: each row links two keys, and each family groups rows into patterns.

A family gives (mid, l, r): the pattern's id and the two keys of a link. Vertices are numbered
within a pattern, left keys before right keys, ascending: the "natural" order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgrain.operators.numbering import numbered_by


def month_links(rows: DataFrame) -> DataFrame:
    """Suppliers and parts of line items, a pattern for each month of shipping."""
    return rows.select(F.concat(F.lit("month-"), F.date_format("l_shipdate", "yyyy-MM")).alias("mid"), F.col("l_suppkey").alias("l"), F.col("l_partkey").alias("r"))


def _month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return month_links(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def _year(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(F.concat(F.lit("year-"), F.date_format("l_shipdate", "yyyy")).alias("mid"), F.col("l_suppkey").alias("l"), F.col("l_partkey").alias("r"))


def _brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts of line items, a pattern for each brand of part."""
    rows, parts = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part"))
    brands = parts.select(F.concat(F.lit("brand-"), "p_brand").alias("mid"), F.col("p_partkey").alias("r"))
    return rows.select(F.col("l_suppkey").alias("l"), F.col("l_partkey").alias("r")).join(brands, "r").select("mid", "l", "r")


def _priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select(F.concat(F.lit("priority-"), "o_orderpriority").alias("mid"), F.col("o_custkey").alias("l"), F.col("o_orderkey").alias("r"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select(F.lit("orders").alias("mid"), F.col("o_custkey").alias("l"), F.col("o_orderkey").alias("r"))


FAMILIES = {"month": _month, "year": _year, "brand": _brand, "priority": _priority, "orders": _orders}


def links(spark: SparkSession, sf_dir: str, families: tuple[str, ...] = ("month",)) -> DataFrame:
    """Distinct (mid, l, r) of the families; rows that lack any of the three are no links."""
    return reduce(DataFrame.unionByName, [FAMILIES[f](spark, sf_dir) for f in families]).dropna().distinct()


def numbered(linked: DataFrame) -> DataFrame:
    """(mid, kind, key, id): every vertex with its number."""
    both = linked.select("mid", F.lit(0).alias("kind"), F.col("l").alias("key")).unionByName(linked.select("mid", F.lit(1).alias("kind"), F.col("r").alias("key"))).distinct()
    return numbered_by(both, "mid", ["kind", "key"], "id").select("mid", "kind", "key", "id")


def numbered_with_degrees(linked: DataFrame) -> DataFrame:
    """(mid, kind, key, degree, id): the same with each vertex's links, which are counted by key, without numbering the links' ends."""
    ends = linked.select("mid", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("l").alias("key")), F.struct(F.lit(1).alias("kind"), F.col("r").alias("key")))).alias("e"))
    counted = ends.groupBy("mid", "e.kind", "e.key").agg(F.count(F.lit(1)).alias("degree"))
    return numbered_by(counted, "mid", ["kind", "key"], "id").select("mid", "kind", "key", "degree", "id")


def edge_list(linked: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mid, a, b) of each link, once, by number."""
    left = vertices.where("kind = 0").select("mid", F.col("key").alias("l"), F.col("id").alias("a"))
    right = vertices.where("kind = 1").select("mid", F.col("key").alias("r"), F.col("id").alias("b"))
    return linked.join(left, ["mid", "l"]).join(right, ["mid", "r"]).select("mid", "a", "b")
