"""Importance resampling toward a target distribution over hashed n-grams.

Each text's runs of consecutive words are hashed into buckets, and the counts are written once as
a sparse document-by-bucket matrix: blocks of rows in compressed form (row ends, bucket numbers,
counts). The matrix's column sums, source against target, give each bucket's gain; its product
with the gains, divided by a row's sum, gives each document's weight. Gumbel noise from the
document's id turns the highest scores into a draw without replacement. Hashing, sums and
products run on numpy arrays of a block at a time; what goes to the driver has a number for each
bucket at most.

Defined results: a null text has no words; a document without features weighs 0; one with fewer
words than asked for is scored but never drawn; rows that share an id are documents of their own
with equal noise; a null id counts as empty text in the noise and comes after all others of its score;
equal scores go by id, then by the order in which they were read; texts are read whole; an empty
table on either side gives counts of zero; other columns are left out.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symgrain.llm.common import fresh_path, materialize, trimmed

BUCKETS, LONGEST, PERCENT, MIN_WORDS, SEED = 10_000, 2, 25, 20, 7
#: Gains go to every task, eight bytes a bucket.
MAX_BUCKETS = 1 << 22
#: Documents of a block, and bytes up to which words are hashed together; longer ones one by one.
BLOCK_ROWS, LONG_WORD = 512, 64
SCHEMA = "part long, block long, ids array<long>, n_words array<long>, ends array<long>, buckets binary, counts binary"


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What each byte becomes, whether it belongs to a word, the CRC-32 of single bytes, and for each number of bytes that may follow what a checksum's four bytes become."""
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32
    word = np.zeros(256, bool)
    word[ord("0") : ord("9") + 1] = word[ord("a") : ord("z") + 1] = word[0x80:] = True
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # linear part
    shifts = np.zeros((LONG_WORD + 2, 4, 256), np.uint32)
    shifts[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, len(shifts)):
        shifts[n] = (shifts[n - 1] >> np.uint32(8)) ^ one[shifts[n - 1] & np.uint32(255)]
    return lower, word, one, shifts


def _behind(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What checksums contribute once so many further bytes follow."""
    shifts, out = _tables()[3], np.zeros(len(sums), np.uint32)
    for k in range(4):
        out ^= shifts[sizes, k, (sums >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes with A-Z lower-cased, and of each word its text, first byte and end. Words are runs of digits, letters and all characters beyond ASCII."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    lower, is_word, *_ = _tables()
    raw = lower[np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    inside = np.concatenate([[False], is_word[raw], [False]])
    first, last = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]  # a word begins here; one ended before here
    cut = ends[(ends > 0) & (ends < len(raw))]
    both = cut[inside[cut] & inside[cut + 1]]  # words that touch across a text's end
    first[both] = last[both] = True
    begin, end = np.flatnonzero(first), np.flatnonzero(last)
    return raw, np.searchsorted(ends[1:], begin, side="right"), begin, end


def checksums(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each stretch of bytes, all at once, byte by byte; long stretches one by one."""
    one, sizes = _tables()[2], end - begin
    order = np.argsort(-np.minimum(sizes, LONG_WORD + 1), kind="stable")
    order = order[np.searchsorted(-sizes[order], -LONG_WORD) :] if len(order) else order
    at, left = begin[order], sizes[order]
    sums = np.full(len(order), 0xFFFFFFFF, np.uint32)
    alive = np.searchsorted(-left, -np.arange(int(left.max(initial=0))))  # how many are longer than that
    for k, n in enumerate(alive):
        sums[:n] = (sums[:n] >> np.uint32(8)) ^ one[(sums[:n] ^ raw[at[:n] + k]) & np.uint32(255)]
    out = np.zeros(len(sizes), np.uint32)
    out[order] = ~sums
    for i in np.flatnonzero(sizes > LONG_WORD):
        out[i] = zlib.crc32(raw[begin[i] : end[i]])
    return out


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text * buckets + bucket of every feature, words of each text). A run's checksum is put together from its words'."""
    raw, owner, begin, end = words_of(texts)
    sums, sizes = checksums(raw, begin, end), end - begin
    space = zlib.crc32(b" ")
    alone = _behind(np.full(LONG_WORD + 1, space, np.uint32), np.arange(LONG_WORD + 1))  # of a space before a word of that size
    found, run = [owner * buckets + sums % buckets], sums
    for n in range(2, longest + 1):
        run, size, last = run[:-1] if len(run) else run, sizes[n - 1 :], sums[n - 1 :]
        short = np.minimum(size, LONG_WORD)
        after = _behind(run, short + 1) ^ alone[short] ^ last
        for i in np.flatnonzero(size > LONG_WORD):
            at = i + n - 1
            after[i] = zlib.crc32(raw[begin[at] : end[at]], zlib.crc32(b" ", int(run[i])))
        run = after
        whole = owner[: len(run)] == owner[n - 1 :]
        found.append((owner[: len(run)] * buckets + run % buckets)[whole])
    return np.concatenate(found), np.bincount(owner, minlength=len(texts))


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def write_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> None:
    """Writes the matrix: a row for each block, of the task and number that tell it apart, the documents' ids and words, where each document's entries end, and the entries' buckets and counts (little-endian unsigned integers; counts of four bytes)."""
    if not 1 <= buckets <= MAX_BUCKETS or longest < 1:
        raise ValueError(f"buckets: 1 to {MAX_BUCKETS}; longest run: 1 or more")

    @trimmed
    def run(batches):
        part, block = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                rows = batch.slice(at, BLOCK_ROWS)
                keys, words = features(rows.column(1), longest, buckets)
                keys, counts = np.unique(keys.astype(np.int32) if rows.num_rows * buckets < 1 << 31 else keys, return_counts=True)
                ends = np.searchsorted(keys, (np.arange(rows.num_rows) + 1) * buckets)
                lists = [pa.array([x], pa.list_(pa.int64())) for x in (rows.column(0).to_pylist(), words, ends)]
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([block]), *lists, pa.array([(keys % buckets).astype(_kind(buckets)).tobytes()]), pa.array([counts.astype("<u4").tobytes()])], SCHEMA.replace(",", "").split()[::2])
                block += 1

    docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the buckets that have entries; each task adds up its blocks first."""

    @trimmed
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for columns, counts in zip(batch.column(0), batch.column(1), strict=True):
                total += np.bincount(np.frombuffer(columns.as_buffer(), _kind(buckets)), np.frombuffer(counts.as_buffer(), "<u4"), buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return matrix.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain, floor(1000 ln of the smoothed share in the target over that in the source), from both column sums."""
    every = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    both = every.select("bucket", "s", "t", F.sum("s").over(W.partitionBy()).alias("all_s"), F.sum("t").over(W.partitionBy()).alias("all_t"))
    gain = F.expr(f"cast(floor(1000 * ln(cast(t + 1 as double) * (all_s + {buckets}) / (cast(s + 1 as double) * (all_t + {buckets})))) as bigint)")
    out = np.zeros(buckets, np.int64)
    for bucket, value in both.select("bucket", gain.alias("gain")).collect():
        out[bucket] = value
    return out


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, part, place, n_words, n_features, weight) of each row of the matrix: the floored mean of its entries' gains."""
    kind = _kind(len(gain))

    @trimmed
    def run(batches):
        for batch in batches:
            for part, block, ids, words, ends, columns, counts in zip(*batch.columns, strict=True):
                stop = np.asarray(ends.values)
                count = np.frombuffer(counts.as_buffer(), "<u4").astype(np.int64)
                product = np.concatenate([[0], np.cumsum(count * gain[np.frombuffer(columns.as_buffer(), kind)])])[np.concatenate([[0], stop])]
                size = np.diff(np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], stop])])
                n = len(stop)
                place = block.as_py() * BLOCK_ROWS + np.arange(n)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(np.full(n, part.as_py())), pa.array(place), words.values, pa.array(size), pa.array(np.diff(product) // np.maximum(size, 1))], ["doc_id", "part", "place", "n_words", "n_features", "weight"])

    return matrix.mapInArrow(run, "doc_id long, part long, place long, n_words long, n_features long, weight long")


def _ranked(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """scored with each drawn row's rank: rows that may be drawn are dealt by ranges of their order and sorted; a row's rank is its place in its range behind all ranges before."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("part"), F.asc("place")]
    dealt = scored.where(F.col("n_words") >= min_words).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    ranges = dealt.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count(F.lit(1)).alias("n"))
    # A row for each task.
    before = ranges.select("_range", (F.sum("n").over(W.orderBy("_range")) - F.col("n")).alias("_before"), F.floor(F.sum("n").over(W.partitionBy()) * percent / 100).alias("_most"))
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = dealt.withColumn("_range", F.shiftright("_at", 33)).join(before, "_range").withColumn("rank", F.when(rank <= F.col("_most"), rank))
    return drawn.select(*scored.columns, "rank").unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST, target_id: str = "item_id") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank (from 1) of the ``percent`` of those with min_words words that score highest, null of all others."""
    spark = docs.sparkSession
    source_path, target_path = fresh_path(spark, "counts"), fresh_path(spark, "target-counts")
    write_counts(docs, source_path, buckets=buckets, longest=longest)
    write_counts(target, target_path, target_id, buckets=buckets, longest=longest)
    source = read_counts(spark, source_path)
    gain = gains(column_sums(source, buckets), column_sums(read_counts(spark, target_path), buckets), buckets)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.ln(-F.ln((noise + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = materialize(weights(source, gain).withColumn("score", F.col("weight") + gumbel), "scored")
    return _ranked(scored, percent, min_words).select("doc_id", "n_features", "weight", "score", "rank")
