"""Token ids in ORC files.

Documents are dealt by range of their id and sorted, tokenized, and written as ORC: integer
run-length encoding for the ids, a row index and a Bloom filter on the document id, so readers
take stripes in parallel and skip those whose statistics or filter exclude an id.

Tokenizing goes through the tokenizers library. Where it splits texts before merging, each
distinct piece of a batch is encoded once and remembered (bounded); other texts go whole, as do
those that hold an added token, which the library finds before it splits.

Defined results: a null text counts as empty and holds the end id alone; texts are encoded
whole; rows that share an id all stay, in one file, and their offsets follow their place in it
(which is a column of its own, ``place``, as ORC rows carry none); null ids come first; an empty
table gives an empty store; other columns are left out.
"""

from __future__ import annotations

import json
import os
import zlib
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symgrain.llm.bpe import PieceEncoder
from symgrain.llm.common import materialize, trimmed

TOKENIZER_FILE = "byte_bpe_50k.json"
SCHEMA = "doc_id long, place long, ids array<int>"
#: Pieces that a worker's memo may hold (some 60 bytes each), and texts encoded at a time.
MEMO_PIECES, DOCS_AT_ONCE = 1_200_000, 1_000


class PieceTokenizer(PieceEncoder):
    """The library's tokenizer of one file, with a memo of pieces; one per Python worker and file. added: added tokens are found in texts, as the file says (the store's way); else they are text like any other."""

    _built: dict[str, PieceTokenizer] = {}

    def __init__(self, path: str, added: bool = False):
        super().__init__(MEMO_PIECES)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as file:
            spec = json.load(file)
        self.tokenizer.encode_special_tokens = not added
        self.whole_if = [token["content"] for token in spec.get("added_tokens") or []]
        first = spec.get("pre_tokenizer") or {}
        self.by_piece = spec.get("normalizer") is None and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")

    @classmethod
    def of(cls, path: str) -> PieceTokenizer:
        if path not in cls._built:
            cls._built[path] = cls(path, added=True)
        return cls._built[path]

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        each = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, each), np.int64, count=len(each))
        return np.fromiter(chain.from_iterable(each), np.int32, count=int(sizes.sum())), sizes


def write_store(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 0, files: int | None = None, stripe_bytes: int = 16 << 20, index_stride: int = 1000) -> None:
    """Writes doc_id, place (within the task's rows) and ids, end_id appended, in ascending doc_id order within and across files (as many as adaptive execution makes, or the given number)."""
    tokenizer_path = tokenizer_path or public_tokenizers.path(TOKENIZER_FILE)

    def run(batches):
        tokenizer, before = PieceTokenizer.of(tokenizer_path), 0
        for batch in batches:
            for start in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(start, DOCS_AT_ONCE)
                values, sizes = tokenizer.encode(part.column(1), end_id)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                places = pa.array(np.arange(before, before + part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column(0), places, pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["doc_id", "place", "ids"])
                before += part.num_rows

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(*([files] if files else []), "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, SCHEMA).write.format("orc").options(**{"compression": "lz4", "orc.stripe.size": stripe_bytes, "orc.row.index.stride": index_stride, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": 0.01}).save(path)


def read_store(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The store's rows; doc_ids, if given, reach the files' statistics and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def index_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files.

    Offsets: a running sum over a task's rows, by place, plus the sum over the tasks before it.
    Tasks hold consecutive ranges, so only one row for each task meets in one task.
    """

    @trimmed
    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            ends = np.asarray(lists.offsets)
            values = np.asarray(lists.values).astype("<u4")
            crcs = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "place", "part", "n_tokens", "ids_crc32"])

    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long")
    rows = read_store(spark, path).select("doc_id", "place", "ids", part.alias("part"))
    each = materialize(rows.mapInArrow(run, "doc_id long, place long, part long, n_tokens long, ids_crc32 long"), "token-index")
    parts = each.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    inside = W.partitionBy("part").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    return each.withColumn("upto", F.sum("n_tokens").over(inside)).join(before, "part").select("doc_id", (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
