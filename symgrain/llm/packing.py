"""Best-fit packing of tokenized documents into sequences of bounded length.

Documents are tokenized where they lie, cut into pieces that fit a sequence, and written once.
Which sequence a piece goes to depends on piece lengths alone, so best-fit decreasing runs over
the counts of each length, of which there are at most as many as a sequence has tokens: a segment
tree over remaining capacities gives the tightest open bin in logarithmic time, and all bins that
are filled alike move through it as one run. The resulting plan, also bounded by the sequence's
length, says where the r-th piece of a length goes; pieces are numbered per length by the counts
of the tasks before, so neither pieces nor documents meet in one task or the driver.

Defined results: a null text counts as empty and is one piece of the end id alone; a document
longer than a sequence is cut into whole sequences, its first piece taking what is left over;
texts are tokenized whole; rows that share an id, or have none, are documents of their own; which
of several equally long pieces goes where follows the order in which they were read; an empty table gives
no pieces; other columns are left out.
"""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symgrain.llm.common import fresh_path, trimmed
from symgrain.llm.token_store import DOCS_AT_ONCE, TOKENIZER_FILE, PieceTokenizer

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END_ID = 1024, 2
#: The plan grows with the square of this at most; it is held by every task.
MAX_CAPACITY = 1 << 16
SCHEMA = "doc_id long, piece int, start long, length long, part long, nth long, ids binary"


class OpenBins:
    """Open bins by remaining capacity: a segment tree tells which capacities have any. Bins that are filled alike and numbered one after another are one run: (first, how many)."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.runs: defaultdict[int, deque[tuple[int, int]]] = defaultdict(deque)

    def tightest(self, needed: int) -> int | None:
        """The least remaining capacity of an open bin that is at least what is needed."""
        node = needed + self.leaves
        while not self.any[node]:
            while node & 1:  # a right child: nothing further right below its parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node + (not self.any[2 * node])
        return node - self.leaves

    def put(self, free: int, first: int, count: int) -> None:
        if not (free and count):
            return
        self.runs[free].append((first, count))
        node = free + self.leaves
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, free: int) -> tuple[int, int]:
        run = self.runs[free].popleft()
        node = free + self.leaves
        if not self.runs[free]:
            self.any[node] = 0
            node >>= 1
            while node and not (self.any[2 * node] or self.any[2 * node + 1]):
                self.any[node] = 0
                node >>= 1
        return run


def best_fit(lengths: dict[int, int], capacity: int) -> np.ndarray:
    """The plan for so many pieces of each length: rows (length, rank, per_bin, sequence, offset), sorted.

    A row holds from the piece of that rank (among those of its length) up to the next row:
    per_bin pieces go to each sequence from the given one on, one behind the other from the
    offset. Pieces are taken longest first and put into the tightest open bin, as best-fit
    decreasing does piece by piece: a bin that took one is the tightest for the next of that
    length, until it is too full.
    """
    bins, opened, plan = OpenBins(capacity), 0, []
    for length in sorted(lengths, reverse=True):
        rank, left = 0, lengths[length]
        while left:
            free = bins.tightest(length)
            if free is None:
                free = capacity
                first, count = opened, -(-left // (capacity // length))
                opened += count
            else:
                first, count = bins.take(free)
            per_bin = free // length
            full = min(count, left // per_bin)
            for n, k in ((full, per_bin), (int(full < count), left - full * per_bin)):
                if n and 0 < k <= per_bin and left:
                    plan.append((length, rank, k, first, capacity - free))
                    bins.put(free - k * length, first, n)
                    rank, left, first, count = rank + n * k, left - n * k, first + n, count - n
            bins.put(free, first, count)
    return np.array(sorted(plan), np.int64).reshape(-1, 5)


def _order_of_equals(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Each piece's number among those of its length, after the ones seen; they are seen then."""
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=len(seen))
    before = np.cumsum(counts) - counts
    nth = np.empty(len(lengths), np.int64)
    nth[order] = np.arange(len(lengths)) + (seen - before)[lengths[order]]
    seen += counts
    return nth


def write_pieces(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> None:
    """Tokenizes, appends the end id, cuts, and writes each piece: its document, number, first token's place, length, the task that read it, its number there among pieces of its length, and its ids (little-endian unsigned 32-bit integers)."""
    if not 1 <= capacity <= MAX_CAPACITY:
        raise ValueError(f"a sequence holds 1 to {MAX_CAPACITY} tokens")
    tokenizer_path = tokenizer_path or public_tokenizers.path(TOKENIZER_FILE)

    @trimmed
    def run(batches):
        tokenizer, part, seen = PieceTokenizer.of(tokenizer_path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                rows = batch.slice(at, DOCS_AT_ONCE)
                values, sizes = tokenizer.encode(rows.column(1), end_id)
                pieces = -(-sizes // capacity)
                owner = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = (sizes - (pieces - 1) * capacity)[owner]
                start, length = np.where(piece, head + (piece - 1) * capacity, 0), np.where(piece, capacity, head)
                ends = np.concatenate([[0], np.cumsum(length)]) * 4
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(owner), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(values.astype("<u4"))])
                columns = [rows.column(0).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(np.full(len(owner), part)), pa.array(_order_of_equals(length, seen)), ids.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, SCHEMA.replace(",", "").split()[::2])

    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
    pieces.write.option("compression", "zstd").parquet(path)


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces that write_pieces wrote; of its columns part, nth and length are read, and part and nth are given up.

    At most ``capacity`` counts go to the driver. The table of counts per task and length is
    joined by shuffle unless Spark finds it small.
    """
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit(lengths, capacity)

    @F.pandas_udf("sequence_id long, offset long")
    def look_up(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        row = plan[np.searchsorted(plan[:, 0] << 45 | plan[:, 1], length.to_numpy() << 45 | rank.to_numpy(), side="right") - 1]
        number = rank.to_numpy() - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 3] + number // row[:, 2], "offset": row[:, 4] + number % row[:, 2] * length.to_numpy()})

    before = counts.select("part", "length", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("_before"))
    ranked = pieces.join(before, ["part", "length"]).withColumn("_at", look_up("length", F.col("_before") + F.col("nth")))
    return ranked.select(*[c for c in pieces.columns if c not in ("part", "nth")], "_at.sequence_id", "_at.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of each piece; the pieces stay in the shared folder."""
    path = fresh_path(docs.sparkSession, "pieces")
    write_pieces(docs, path, tokenizer_path, end_id, capacity)
    return place(read_pieces(docs.sparkSession, path), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, documents array of (doc_id, piece, start, offset, length), ids binary) of each sequence. A group is one sequence, so it is bounded."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length", "ids")))
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), rows.alias("rows"))
    fields = lambda r: F.struct(*[r[c].alias(c) for c in ("doc_id", "piece", "start", "offset", "length")])
    return whole.select("sequence_id", "n_tokens", F.transform("rows", fields).alias("documents"), F.aggregate("rows", F.lit(b""), lambda done, r: F.concat(done, r["ids"])).alias("ids"))


def digests(docs: DataFrame) -> DataFrame:
    """Packed pieces with the checksum of their ids in place of the ids, which then stay where they were written."""
    path = fresh_path(docs.sparkSession, "pieces")
    write_pieces(docs, path)
    pieces = read_pieces(docs.sparkSession, path)
    return place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
