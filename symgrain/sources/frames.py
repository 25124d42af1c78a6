"""Pattern and order files as a Spark data source: ``spark.read.format("frames").load(folder)``, ``df.write.format("frames").save(folder)``.

A file holds one pattern or order (option ``kind``), framed as ``sources.binary`` says, and is
named after it. Reading takes one partition a file and gives a row for each; a file that is cut
off or holds anything else gives a row that says so. Tasks write into a folder of their own job
below the target; only when all are done are the files moved into place, so a task that runs twice
or a job that fails leaves nothing behind. With overwrite, the target's former files go first.

Kind ``pieces`` takes and gives the same pattern files by some columns at a time (``pattern.pieces``), so that
no task holds a pattern: the pieces of a pattern come to one task, by column; rows follow the column starts
in the file, so they wait in a file beside it. Pieces that leave a gap or are out of turn fail the job.

Folders are local paths or URIs that pyarrow's file systems know. A null name, two rows of one name in
a job and an array with nulls or numbers below zero fail the job; an empty table gives an empty folder; an
empty or missing folder no rows.
"""

from __future__ import annotations

import struct
import uuid
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from symgrain.sources.binary import Broken, column_rows, column_starts, order_bytes, order_from, pattern_bytes, pattern_from, pattern_sizes

ENDING = ".frame"
#: Columns of a piece that is read, pieces of a batch, bytes copied at a time.
PIECE_COLUMNS, PIECES, COPY_BYTES = 256, 64, 1 << 20
SCHEMAS = {"pattern": "mid string, n long, col_at array<long>, rows array<long>, fault string", "pieces": "mid string, n long, col long, col_at array<long>, rows array<long>, fault string", "order": "mid string, order array<long>, fault string"}


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where it is, its name


def _opened(options: dict) -> tuple[fs.FileSystem, str]:
    path = options["path"]
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _frames(files: fs.FileSystem, folder: str) -> list[str]:
    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.path.endswith(ENDING))


class _Reader(DataSourceReader):
    def __init__(self, options: dict, kind: str):
        self.options, self.kind = options, kind

    def partitions(self):
        return [_File(path) for path in _frames(*_opened(self.options))] or [_File("")]

    def read(self, partition):
        if not partition.path:
            return
        files, _ = _opened(self.options)
        with files.open_input_file(partition.path) as file:
            data = file.read()
        mid = unquote(partition.path.rpartition("/")[2].removesuffix(ENDING))
        try:
            whole = pattern_from(data) if self.kind == "pattern" else (order_from(data),)
            yield (mid, *(x if isinstance(x, int) else x.tolist() for x in whole), None)
        except Broken as error:
            yield (mid, *[None] * (3 if self.kind == "pattern" else 1), str(error))


class _PieceReader(_Reader):
    def read(self, partition):
        if not partition.path:
            return
        files, _ = _opened(self.options)
        mid = unquote(partition.path.rpartition("/")[2].removesuffix(ENDING))
        names = [c.split()[0] for c in SCHEMAS["pieces"].split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 2, pa.string()]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        with files.open_input_file(partition.path) as file:
            try:
                n, _ = pattern_sizes(file, file.size())
            except Broken as error:
                yield batch([(mid, None, None, None, None, str(error))])
                return
            some = []
            for first in range(0, max(n, 1), PIECE_COLUMNS):
                starts = column_starts(file, first, min(first + PIECE_COLUMNS, n) + 1)
                some.append((mid, n, first, starts, column_rows(file, n, int(starts[0]), int(starts[-1])), None))
                if len(some) == PIECES or first + PIECE_COLUMNS >= n:
                    yield batch(some)
                    some = []


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, kind: str, overwrite: bool):
        self.options, self.kind, self.overwrite, self.job = options, kind, overwrite, uuid.uuid4().hex

    def _staging(self, folder: str) -> str:
        return f"{folder.rstrip('/')}/_writing-{self.job}"

    def write(self, iterator):
        files, folder = _opened(self.options)
        own, done = f"{self._staging(folder)}/{uuid.uuid4().hex}", []
        for row in iterator:
            if row["mid"] is None:
                raise ValueError("a pattern without a name cannot be a file")
            arrays = [row["col_at"], row["rows"]] if self.kind == "pattern" else [row["order"]]
            if any(x is None or None in x or (len(x) and np.min(x) < 0) for x in arrays):
                raise ValueError(f"{row['mid']}: numbers from 0 are needed")
            data = pattern_bytes(row["n"], *arrays) if self.kind == "pattern" else order_bytes(*arrays)
            files.create_dir(own, recursive=True)
            name = quote(row["mid"], safe="") + ENDING
            with files.open_output_stream(f"{own}/{name}") as file:
                file.write(data)
            done.append((f"{own}/{name}", name))
        return _Written(done)

    def commit(self, messages):
        files, folder = _opened(self.options)
        every = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in every]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two patterns of one name")
        files.create_dir(folder, recursive=True)
        if self.overwrite:
            for path in _frames(files, folder):
                files.delete_file(path)
        for path, name in every:
            files.move(path, f"{folder.rstrip('/')}/{name}")
        self.abort(messages)

    def abort(self, messages):
        files, folder = _opened(self.options)
        if files.get_file_info(self._staging(folder)).type != fs.FileType.NotFound:
            files.delete_dir(self._staging(folder))


class _PieceWriter(_Writer, DataSourceArrowWriter):
    def write(self, iterator):
        files, folder = _opened(self.options)
        own, done, mid, open_ = f"{self._staging(folder)}/{uuid.uuid4().hex}", [], None, None
        number = lambda x: struct.pack("<Q", x)

        def end():
            head, tail, path, n, col, rows = open_
            tail.close()
            if col != n:
                raise ValueError(f"{mid}: columns {col} to {n} are missing")
            head.write(number(rows))
            with files.open_input_stream(path + ".rows") as file:
                while block := file.read(COPY_BYTES):
                    head.write(block)
            head.close()
            files.delete_file(path + ".rows")

        for batch in iterator:
            columns = {name: batch.column(name) for name in ("mid", "n", "col", "col_at", "rows")}
            for at in range(batch.num_rows):
                name, n, col = (columns[c][at].as_py() for c in ("mid", "n", "col"))
                starts, rows = (columns[c][at].values for c in ("col_at", "rows"))
                if name is None:
                    raise ValueError("a pattern without a name cannot be a file")
                if n is None or col is None or any(x is None or x.null_count or (len(x) and np.min(x) < 0) for x in (starts, rows)):
                    raise ValueError(f"{name}: numbers from 0 are needed")
                if name != mid:
                    if open_:
                        end()
                    mid, file = name, quote(name, safe="") + ENDING
                    files.create_dir(own, recursive=True)
                    path = f"{own}/{file}"
                    if (path, file) in done:
                        raise ValueError(f"{mid}: its pieces are not together")
                    done.append((path, file))
                    open_ = [files.open_output_stream(path), files.open_output_stream(path + ".rows"), path, n, 0, 0]
                    open_[0].write(number(n) + number(n + 1) + number(0))
                starts, rows = np.asarray(starts), np.asarray(rows)
                if n != open_[3] or col != open_[4] or not len(starts) or starts[0] != open_[5] or starts[-1] - starts[0] != len(rows):
                    raise ValueError(f"{mid}: column {open_[4]} should come next")
                open_[0].write(starts[1:].astype("<u8").tobytes())
                open_[1].write(rows.astype("<u8").tobytes())
                open_[4] += len(starts) - 1
                open_[5] += len(rows)
        if open_:
            end()
        return _Written(done)


class FrameSource(DataSource):
    @classmethod
    def name(cls):
        return "frames"

    @property
    def kind(self) -> str:
        return self.options.get("kind", "pattern")

    def schema(self):
        return SCHEMAS[self.kind]

    def reader(self, schema):
        return (_PieceReader if self.kind == "pieces" else _Reader)(dict(self.options), self.kind)

    def writer(self, schema, overwrite):
        return (_PieceWriter if self.kind == "pieces" else _Writer)(dict(self.options), self.kind, overwrite)


def register_frames(spark: SparkSession) -> None:
    spark.dataSource.register(FrameSource)
