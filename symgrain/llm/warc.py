"""WARC archives: written from captures, read back, and assembled into transactions.

Each capture gives three records: a request, a response (or a revisit, which names the record
that holds the same payload), and metadata. The request and the metadata name the response in
WARC-Concurrent-To, by which reading joins them to one nested row per capture.

Records are built as text columns and written by Spark's own text writer with CRLF CRLF, a
record's end, as the line separator: writes are committed like any other table's, and go to
any file system. Files are gzipped unless asked otherwise. Each task starts a new archive when the last one holds ``archive_bytes`` of
payload, so a file is that large at most, but for one last payload. Reading parses whole files,
by Content-Length.

Every row is a capture with record ids of its own, made from its place in the input
(monotonically_increasing_id): a table that is not files, which give the same rows to the same
tasks when read twice, is written first.

Assembly joins by the transaction's id, a response's own or those in WARC-Concurrent-To, in one
shuffle of all three kinds: a group holds a capture's records. A record that names several
belongs to each that is a response; what names no response in the archives is a capture
without one. Of several requests, or responses of one id, the whole one that compares highest is taken; all
metadata records are kept, by record id.

Defined results: a null payload counts as empty; payloads under ``least_bytes`` are never
revisits; rows that repeat page_id and payload each give a row, and of those with the smallest
page_id each holds the payload; a null page_id counts as larger than any other; a null url
leaves out WARC-Target-URI, and line breaks in one are percent-encoded; an empty table gives no
captures; other columns are left out.
"""

from __future__ import annotations

import gzip
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symgrain.llm.common import as_stored, materialize, trimmed

END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Rows of (digest, first page) that may be broadcast (about 100 bytes each); beyond it they are joined by shuffle.
BROADCAST_ROWS = 200_000
ARCHIVE_BYTES = 64 << 20


def _record_id(kind: str, place: Column, digest: Column) -> Column:
    name = F.md5(F.concat_ws("|", F.lit(kind), place.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(name, a, n), F.lit("-" if a < 21 else ">"))])


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """One record without its end; headers that are null are left out."""
    lines = [F.lit("WARC/1.1" + END), *[F.coalesce(F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit(END)), F.lit("")) for name, value in headers]]
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END + END), block)


def _in_volumes(captures: DataFrame, archive_bytes: int) -> DataFrame:
    """Adds ``volume``: the number of the task's archive that a row goes into."""

    @trimmed
    def run(batches):
        volume, held = 0, 0
        for batch in batches:
            volumes = np.empty(batch.num_rows, np.int32)
            for at, size in enumerate(batch.column("size").to_pylist()):
                if held >= archive_bytes:
                    volume, held = volume + 1, 0
                volumes[at] = volume
                held += size + 1000  # headers
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(volumes)], [*batch.schema.names, "volume"])

    return captures.mapInArrow(run, "digest string, page_id long, url string, html string, place long, size int, first long, first_place long, volume int")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 100, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes the captures (page_id, url, html) as WARC files."""
    html = F.coalesce("html", F.lit(""))
    captures = as_stored(pages, "warc-pages").select(F.col("page_id").cast("long"), "url", html.alias("html"), F.monotonically_increasing_id().alias("place")).withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html"))
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "place")))
    firsts = materialize(captures.where(F.col("size") >= least_bytes).groupBy("digest").agg(least.alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1 AND f IS NOT NULL").select("digest", F.col("f.page_id").alias("first"), F.col("f.place").alias("first_place")), "warc-firsts")
    few = firsts.count() <= BROADCAST_ROWS
    # Numbered behind the join: a shuffle deals the rows to other tasks.
    captures = _in_volumes(captures.join(F.broadcast(firsts) if few else firsts, "digest", "left").select("digest", "page_id", "url", "html", "place", "size", "first", "first_place"), archive_bytes)

    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    this, uri = _record_id("response", F.col("place"), F.col("digest")), F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    bare = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "^[^:]*://[^/?#]*", ""), r"[\s]", "%20")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("size").cast("string"), F.lit(END + END))
    common = [("WARC-Date", date), ("WARC-Target-URI", uri)]
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", _record_id("request", F.col("place"), F.col("digest"))), ("WARC-Concurrent-To", this), *common, ("Content-Type", "application/http; msgtype=request")], F.concat(F.lit("GET "), F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare)), F.lit(f" HTTP/1.1{END}{END}")))
    response = _record(
        [("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", this), *common, ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
         ("WARC-Profile", F.when(revisit, F.lit(PROFILE))), ("WARC-Refers-To", F.when(revisit, _record_id("response", F.col("first_place"), F.col("digest")))), ("Content-Type", "application/http; msgtype=response")],
        F.concat(head, F.when(revisit, "").otherwise(F.col("html"))),
    )
    metadata = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", _record_id("metadata", F.col("place"), F.col("digest"))), ("WARC-Concurrent-To", this), *common, ("Content-Type", "application/warc-fields")], F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(END)), F.lit("")))
    records = captures.select("volume", F.explode(F.array(request, response, metadata)).alias("value"))
    records.write.option("lineSep", END + END).option("compression", compression).partitionBy("volume").text(path)


#: The header that may stand more than once; its values are joined by spaces.
REPEATED = "warc-concurrent-to"


def parse_records(data: bytes):
    """(headers by lower-case name, block) of each record; raises on what is not a record."""
    if data[:2] == b"\x1f\x8b":
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as file:  # member by member
            data = file.read()
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:stop].decode("utf-8", "replace").split(END)[1:]
        headers: dict[str, str] = {}
        for name, _, value in (line.partition(":") for line in lines):
            name, value = name.strip().lower(), value.strip()
            headers[name] = f"{headers[name]} {value}" if name == REPEATED and name in headers else value
        size, begin = int(headers["content-length"]), stop + 4
        if begin + size > len(data) or data[begin + size : begin + size + 4] not in (b"\r\n\r\n", b""):
            raise ValueError(f"the record at byte {at} is cut off")
        yield headers, data[begin : begin + size]
        at = begin + size + 4


_FIELDS = {"record_id": "warc-record-id", "type": "warc-type", "concurrent_to": "warc-concurrent-to", "refers_to": "warc-refers-to", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest"}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: the named headers, http_head and payload (of application/http, what follows its head)."""

    @trimmed
    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                columns: dict[str, list] = {name: [] for name in (*_FIELDS, "http_head", "payload")}
                for headers, block in parse_records(content.as_py()):
                    head = None
                    if headers.get("content-type", "").startswith("application/http"):
                        head, _, block = block.partition(b"\r\n\r\n")
                        head = head.decode("utf-8", "replace")
                    for name, header in _FIELDS.items():
                        columns[name].append(headers.get(header))
                    columns["http_head"].append(head)
                    columns["payload"].append(block)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "payload" else pa.string()) for k, v in columns.items()], list(columns))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"{n} string" for n in (*_FIELDS, "http_head")) + ", payload binary")


_PARTS = {
    "request": ("record_id", "http_head"),
    "response": ("record_id", "type", "target_uri", "date", "refers_to", "payload_digest", "http_head", "payload", "digest", "bytes"),
    "metadata": ("record_id", "payload"),
}


#: What captures need: no payloads but the metadata's.
_SLIM = {"request": ("record_id",), "response": ("type", "refers_to", "digest", "bytes"), "metadata": ("record_id", "payload")}


def assemble(records: DataFrame, parts: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One nested row per capture: capture_id, request and response with the named fields (all by default), and metadata, an array of such. Each part comes from one record. Fields that are not named are not shuffled."""
    parts = _PARTS if parts is None else parts
    answer, none = F.col("type").isin("response", "revisit"), F.array(F.lit(None).cast("string"))
    named = F.when(F.coalesce("concurrent_to", F.lit("")) != "", F.split("concurrent_to", " +"))
    ids = F.when(answer, F.array("record_id")).otherwise(F.coalesce(named, F.array("record_id"), none))
    keyed = records.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("alone", F.size(ids) == 1).withColumn("capture_id", F.explode(ids))
    of = lambda part: F.when(answer if part == "response" else F.col("type") == part, F.struct(*parts[part]))
    found = {part: F.sort_array(F.collect_list(of(part))) if part == "metadata" else F.max(of(part)) for part in parts}
    joined = keyed.groupBy("capture_id").agg(*[column.alias(part) for part, column in found.items()], F.bool_or(answer | F.col("alone")).alias("own"))
    return joined.where("own").drop("own")


def captures(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each capture in the archives; what a revisit lacks comes from the record that it refers to."""
    rows = assemble(read_records(spark, path), _SLIM).select(
        "capture_id", F.regexp_extract(F.get("metadata.payload", F.lit(0)).cast("string"), r"page-id: (-?\d+)", 1).try_cast("long").alias("page_id"), F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("refers_to_id"), F.col("response.digest").alias("digest"), F.col("response.bytes").alias("bytes"),
    )
    rows = materialize(rows, "warc-captures")
    held = rows.where("record_type = 'response'").select(F.col("capture_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("digest").alias("held_digest"), F.col("bytes").alias("held_bytes"))
    joined = rows.join(held, "refers_to_id", "left")
    return joined.select("page_id", F.coalesce("held_bytes", "bytes").alias("payload_bytes"), F.coalesce("held_digest", "digest").alias("payload_digest"), "record_type", "refers_to")
