"""Buckets of rows that share a key, dealt out so that no task holds an unbounded one.

A bucket of more than ``cap`` members is cut into blocks; each pair of blocks becomes a cell
of its own, so any two members still meet in one cell and a cell holds 2 x cap at most (blocks
are dealt by hash, so about that).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrain.llm.common import materialize

#: Rows of (key, size) that may be broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 100_000


def deal(keyed: DataFrame, cap: int, key: str = "key", node: str = "node", tasks: int = 0, weight: str | None = None, most: int = 0) -> DataFrame:
    """Adds ``cell`` (long), ``block`` (int, within the bucket) and ``own`` (boolean: the cell pairs a block with itself); partitions by cell (into the session's number of shuffle partitions, ``tasks`` at least) and sorts by it. weight, if given, is a column whose sum over a block may be about ``most``."""
    members = F.count(F.lit(1))
    if weight:
        members = F.greatest(members, F.ceil(F.sum(weight) * cap / most))
    hot = materialize(keyed.groupBy(key).agg(members.alias("members")).where(F.col("members") > cap), "hot-buckets")
    n_hot = hot.count()
    if not n_hot:
        dealt = keyed.select("*", F.col(key).alias("cell"), F.lit(0).alias("block"), F.lit(True).alias("own"))
    else:
        sizes = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
        blocks = F.coalesce(F.ceil(F.col("members") / F.lit(cap)), F.lit(1)).cast("int")
        dealt = keyed.join(sizes, key, "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(node), "blocks").cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pair = F.xxhash64(key, F.least("block", "other"), F.greatest("block", "other"))
        dealt = dealt.withColumn("cell", F.when(F.col("blocks") == 1, F.col(key)).otherwise(pair)).withColumn("own", F.col("block") == F.col("other")).drop("members", "blocks", "other")
    if tasks:
        dealt = dealt.repartition(max(tasks, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "cell")
    else:
        dealt = dealt.repartition("cell")
    return dealt.sortWithinPartitions("cell")


def by_cells(batches: Iterator[pa.RecordBatch], handle: Callable[[np.ndarray, pa.Table], Iterator[pa.RecordBatch]], rows: int = 60_000, column: str = "cell") -> Iterator[pa.RecordBatch]:
    """Calls handle with the cell of each row and a table of whole cells, some ``rows`` rows at a time; batches are sorted by cell. Cells of one member are left out."""

    def flush(parts: list[pa.RecordBatch], last: bool):
        whole = pa.Table.from_batches(parts)
        cells = whole.column(column).to_numpy()
        cut = len(cells) if last else int(np.searchsorted(cells, cells[-1]))
        taken, left = cells[:cut], whole.slice(cut)
        if cut:
            same = taken[1:] == taken[:-1]
            keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            if keep.any():
                yield from handle(taken[keep], whole.slice(0, cut).filter(pa.array(keep)).combine_chunks())
        parts[:] = left.combine_chunks().to_batches() if left.num_rows else []

    parts: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            parts.append(batch)
            if sum(p.num_rows for p in parts) >= rows and parts[0].column(column)[0] != batch.column(column)[-1]:
                yield from flush(parts, False)
    if parts:
        yield from flush(parts, True)


def starts_of(cells: np.ndarray) -> np.ndarray:
    """For each place the first place of its run of equal cells."""
    first = np.concatenate([[True], cells[1:] != cells[:-1]])
    return np.maximum.accumulate(np.where(first, np.arange(len(cells)), 0))


def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all half-open ranges one after another, and which range each belongs to."""
    sizes = np.maximum(high - low, 0)
    owner = np.repeat(np.arange(len(low)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[owner], owner


def spanning(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """least_linked, and the places of links that suffice to join what the links join, the first of several."""
    labels, used, open_ = labels.copy(), [], np.arange(len(a))
    while True:
        x, y = labels[a[open_]], labels[b[open_]]
        apart = x != y
        open_, x, y = open_[apart], x[apart], y[apart]
        if not len(open_):
            return labels, np.concatenate([np.empty(0, np.int64), *used])
        high, first = np.unique(np.maximum(x, y), return_index=True)
        used.append(open_[first])
        labels[high] = np.minimum(x, y)[first]
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def least_linked(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the links a-b to components given by labels (of each place, the least place of its component)."""
    while True:
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            return labels
        a, b = a[open_], b[open_]
        np.minimum.at(labels, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
