"""Numbers the rows of groups without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symgrain.operators.checkpoints import stored


def numbered_by(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: each row's place in its group, from 0, by the order's columns (with which no two rows of a group agree).

    Rows are dealt by ranges of (group, order) and sorted; each range counts its rows of each
    group, and only these counts are summed in a window. The sorted rows are written, so
    counts and places are of the same ranges.
    """
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt = stored(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "dealt")
    counts = dealt.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy(group).orderBy("_part")) - F.col("_n")).drop("_n")
    return dealt.join(before, [group, "_part"]).withColumn(name, F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")
