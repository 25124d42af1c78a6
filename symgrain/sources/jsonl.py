"""JSON-lines corpora: one pattern per line, {n, nnz, indptr, indices, hash, source}, diagonal included.

Only n, indptr, indices and source are read. A line that is no pattern gets a reason; strict
loading raises the first one, by path and place in the file.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symgrain.operators.pattern import faults, unpack
from symgrain.operators.policy import bare

SCHEMA = "n long, indptr array<bigint>, indices array<bigint>, source string"
CORPUS_VARIABLE = "SYMGRAIN_CORPUS_FILE"
_POINTER = "version https://git-lfs"


def corpus_path(default: str, given: str | None = None) -> str:
    """The given path, or the environment's, unless blank; else the default."""
    named = os.environ.get(CORPUS_VARIABLE) if given is None else given
    return named.strip() if named and named.strip() else default


def is_pointer(spark: SparkSession, path: str) -> bool:
    """Whether the file holds a pointer to large-file storage instead of the corpus; reads one line."""
    first = spark.read.text(path).limit(1).first()
    return first is not None and first["value"].startswith(_POINTER)


def shortened(text, width: int = 80):
    """The first characters, and an ellipsis if there were more."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("…"))).otherwise(text)


def integer_field(line, key: str):
    """A whole non-negative number under a key of a JSON text, else null."""
    return F.when(F.get_json_object(line, f"$.{key}").rlike(r"^\d+$"), F.get_json_object(line, f"$.{key}").try_cast("long"))


def text_field(line, key: str):
    return F.get_json_object(line, f"$.{key}")


def integers_field(line, key: str):
    """An array of whole numbers under a key, else null."""
    return F.from_json(F.get_json_object(line, f"$.{key}"), "array<bigint>")


def parse(lines: DataFrame) -> DataFrame:
    """Lines (seq, value) as packed patterns: seq, mid, n, col_at, rows, fault; blank lines are no lines."""
    kept = lines.where(bare(F.col("value")) != "")
    read = kept.withColumn("j", F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}))
    packed = read.select("seq", "value", F.coalesce("j.source", F.lit("")).alias("mid"), F.col("j.n").alias("n"), F.col("j.indptr").alias("col_at"), F.col("j.indices").alias("rows"))
    return faults(packed).withColumn("fault", F.when(F.col("fault").isNotNull(), F.concat("fault", F.lit(": "), shortened(F.col("value"))))).drop("value")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """parse() of the files under path. seq numbers lines by path and place in the file."""
    return parse(file_order(spark.read.text(path)))


def file_order(lines: DataFrame) -> DataFrame:
    """(seq, value): lines of text files, numbered. Spark deals files by size, so each block's lines are counted first; only one row per block meets in one task."""
    placed = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = placed.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = blocks.select("file", "block", "first", (F.sum("n").over(W.orderBy("file", "block")) - F.col("n")).alias("before"))
    return placed.join(before, ["file", "block"]).select((F.col("before") + F.col("at") - F.col("first")).alias("seq"), "value")


def load(spark: SparkSession, path: str) -> DataFrame:
    """Packed patterns without faults; raises the first fault. A path that does not exist is an empty corpus."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "seq long, mid string, n long, col_at array<bigint>, rows array<bigint>")
    if is_pointer(spark, path):
        raise ValueError(f"{path} is a pointer to large-file storage, not a corpus")
    rows = scan(spark, path)
    bad = rows.where("fault IS NOT NULL").agg(F.min(F.struct("seq", "fault")).alias("first")).first()["first"]
    if bad:
        raise ValueError(f"corpus line {bad['seq']}: {bad['fault']}")
    return rows.drop("fault")


def edges_of(packed: DataFrame) -> DataFrame:
    return unpack(packed.where("fault IS NULL") if "fault" in packed.columns else packed).distinct()


def write(packed: DataFrame, path: str) -> None:
    """Packed patterns (mid, n, col_at, rows) as JSON lines."""
    packed.select("n", F.size("rows").alias("nnz"), F.col("col_at").alias("indptr"), F.col("rows").alias("indices"), F.col("mid").alias("source")).write.json(path)
