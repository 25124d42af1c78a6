"""Checks of orders and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_faults(orders: DataFrame, sizes: DataFrame) -> DataFrame:
    """(mid, candidate, n, fault): what keeps an order from being one: its length, a vertex out of range, a vertex twice; null if nothing. sizes: (mid, n); a pattern without rows is an order only if n = 0."""
    seen = orders.groupBy("mid", "candidate").agg(F.count(F.lit(1)).alias("length"), F.count_distinct("v").alias("different"), F.min("v").alias("low"), F.max("v").alias("high"), F.count_if(F.col("v").isNull()).alias("nulls"))
    fault = F.when(F.coalesce("length", F.lit(0)) != F.col("n"), "length").when((F.col("nulls") > 0) | (F.col("low") < 0) | (F.col("high") >= F.col("n")), "range").when(F.col("different") != F.col("length"), "repeat")
    return sizes.select("mid", "n").join(seen, "mid", "left").select("mid", "candidate", "n", fault.alias("fault"))


def differing(first: DataFrame, second: DataFrame) -> DataFrame:
    """(mid, candidate, k) where two runs' orders differ."""
    both = first.select("mid", "candidate", "k", F.col("v").alias("x")).join(second.select("mid", "candidate", "k", F.col("v").alias("y")), ["mid", "candidate", "k"], "full_outer")
    return both.where(~F.col("x").eqNullSafe(F.col("y"))).select("mid", "candidate", "k")


def digest(orders: DataFrame) -> DataFrame:
    """(mid, candidate, digest): a sum of hashes that two equal orders share."""
    return orders.groupBy("mid", "candidate").agg(F.sum(F.xxhash64("k", "v") % 1_000_000_007).alias("digest"))


def run_status(outcomes: DataFrame) -> DataFrame:
    """(status, reason) of a whole run: FAIL with the first failure's reason, else OK. outcomes: (seq, reason null if fine)."""
    first = outcomes.agg(F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("seq"))).alias("reason"))
    return first.select(F.when(F.col("reason").isNull(), "OK").otherwise("FAIL").alias("status"), "reason")


def exit_reason(code: Column) -> Column:
    """What an exit code says: negative codes are signals."""
    return F.when(code == 0, F.lit(None).cast("string")).when(code < 0, F.concat(F.lit("killed by signal "), (-code).cast("string"))).when(code.isNull(), "no exit status").otherwise(F.concat(F.lit("exit code "), code.cast("string")))
