"""Scores corpora as files arrive: an addition of this engine, built on the batch operators."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symgrain.operators.pattern import entries
from symgrain.plans.bestof import admitted, best_of
from symgrain.sources.jsonl import parse


def score_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Reads JSON-lines files that arrive in a folder and appends each pattern's best order's figures to Parquet. Each batch writes to its own folder, so one that is run again replaces itself."""
    lines = spark.readStream.text(folder).select(F.lit(0).cast("long").alias("seq"), "value")

    def handle(batch, number):
        packed = parse(batch).where("fault IS NULL").select("mid", "n", "col_at", "rows")
        sizes = packed.select("mid", "n", entries().alias("nnz"))
        best_of(packed, admitted(sizes)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return lines.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
