"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Ids that may be broadcast (some 50 bytes each in the driver's hashed relation); beyond it tables are joined by shuffle.
BROADCAST_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset (tests, local mode), a temporary one, set for the session."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="symgrain-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df once as Parquet into the shared folder and reads it back, so a lost executor costs no recomputation of what lies before."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_stored(df: DataFrame, name: str) -> DataFrame:
    """df itself if it reads files, which deal the same rows to the same tasks each time; else written first."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return df if plan.getClass().getSimpleName() == "LogicalRelation" else materialize(df, name)


def trimmed(run):
    """Wraps a function over Arrow batches: when a task ends, its worker, which waits for the next one, hands freed memory back."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    edges: (a long, b long), in either direction, repeats and loops allowed. Returns (node,
    component). Alternates the large-star and small-star steps, which need about log(n) rounds
    however long the chains are. Minima are aggregated before the shuffle; the joins on a hub
    are sort-merge joins that adaptive execution splits. Each round is written to the shared
    folder. Raises if max_rounds do not suffice; no link is dropped.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = materialize(pairs, "cc")
    mark = None
    for _ in range(max_rounds):
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # The exclusive or with nothing hides how the minima are partitioned, so the join shuffles both sides itself, and adaptive execution can split a hub.
        least = least.select(F.col("u").bitwiseXOR(F.lit(0).cast("long")).alias("u"), "m")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = materialize(kept.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "cc")
        seen = pairs.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.count_distinct("u")).first()
        if seen == mark and seen[0] == seen[2]:
            break
        mark = seen
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
