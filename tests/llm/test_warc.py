import gzip
import hashlib

import pytest

from symgrain.llm import warc


def brute(rows):
    firsts = {}
    for page_id, _, html in rows:
        if html and len(html.encode()) >= 100 and page_id is not None:
            firsts[html] = min(page_id, firsts.get(html, page_id))
    out = []
    for page_id, _, html in rows:
        first = firsts.get(html)
        data = (html or "").encode()
        again = first is not None and page_id != first
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


LONG, TRICKY = "é" * 60, "WARC/1.1\r\n\r\n\r\n\r\nContent-Length: 5\r\n\r\nx" * 5
ROWS = [(7, "http://a/b?c", LONG), (3, "http://a/é x", LONG), (9, None, LONG), (9, None, LONG), (1, "no scheme", None), (2, "http://a\r\nX: y", ""), (4, "u", "short"), (5, "u", "short"), (6, "http://t", TRICKY), (8, "http://t", TRICKY), (None, "u", LONG), (10, "u", "퟿\r\n" * 20000), (9, "u", "other"), (3, "http://second/url", LONG), (3, "http://a/é x", LONG), (12, "u", "z" * 3_000_000), (13, "u", "z" * 3_000_000)]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, tmp_path, compression):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3).selectExpr("*", "'d' as digest", "1 as size")
    path = str(tmp_path / "warc")
    pages.write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    warc.write_archives(pages, path, compression=compression, archive_bytes=5000)
    got = list(map(tuple, warc.captures(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    assert sorted(got, key=str) == brute(ROWS)
    records = warc.read_records(spark, path)
    assert records.count() == 3 * len(ROWS) == records.select("record_id").distinct().count()
    assert {r["target_uri"] for r in records.where("type = 'request'").collect()} >= {"http://second/url", "http://a/é x"}
    if compression == "none":
        sizes = [f.stat().st_size for f in (tmp_path / "warc").rglob("part-*")]
        assert len(sizes) > 3 and all(n < 5000 + 6000 or n > 100_000 for n in sizes)
    nested = {r["metadata"][0]["payload"].decode(): r for r in warc.assemble(warc.read_records(spark, path)).collect()}
    assert nested["page-id: 6\r\n"]["response"]["payload"].decode() == TRICKY
    assert nested["page-id: 7\r\n"]["request"]["http_head"].startswith("GET /b?c HTTP/1.1")
    assert all(r["request"]["record_id"] for r in nested.values())


@pytest.mark.parametrize("rows", [0, 200_000])
def test_archives_stay_small_and_input_need_not_be_files(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        pages = spark.range(0, 600, 1, 16).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "repeat(concat('text ', id % 200, ' '), 30) AS html", "rand() AS other").repartition(16)
        warc.write_archives(pages, str(tmp_path / "w"), archive_bytes=8000, compression="none")
        got = warc.captures(spark, str(tmp_path / "w")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(f.stat().st_size for f in (tmp_path / "w").rglob("part-*")) < 8000 + 3000
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == [(i, "response" if i < 200 else "revisit", None if i < 200 else i % 200) for i in range(600)]


def test_assembly_takes_whole_records(spark, tmp_path):
    def record(kind, name, block, *concurrent):
        heads = "".join(f"WARC-Concurrent-To: {c}\r\n" for c in concurrent)
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}\r\n{heads}Content-Length: {len(block)}\r\n\r\n{block}\r\n\r\n"

    text = record("response", "<r1>", "one") + record("metadata", "<m1>", "zzz", "<r1>") + record("metadata", "<m2>", "aaa", "<r1>") + record("request", "<q>", "both", "<m1>", "<r1>", "<r2>") + record("response", "<r2>", "two") + record("metadata", "<lost>", "alone", "<gone>") + record("metadata", "<free>", "none")
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "part-0").write_bytes(text.encode())
    got = {r["capture_id"]: r for r in warc.assemble(warc.read_records(spark, str(tmp_path / "w"))).collect()}
    assert got.keys() == {"<r1>", "<r2>", "<gone>", "<free>"}
    assert [(m["record_id"], m["payload"]) for m in got["<r1>"]["metadata"]] == [("<m1>", b"zzz"), ("<m2>", b"aaa")]
    assert got["<r1>"]["request"]["record_id"] == got["<r2>"]["request"]["record_id"] == "<q>"
    assert got["<r2>"]["metadata"] == [] and got["<gone>"]["response"] is None and got["<r1>"]["response"]["payload"] == b"one"


def test_no_pages(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none"))
    assert warc.captures(spark, str(tmp_path / "none")).count() == 0


def test_parsing_members_and_damage():
    record = b"WARC/1.0\r\nWARC-Type: request\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert [b for _, b in warc.parse_records(gzip.compress(record) + gzip.compress(record))] == [b"hi", b"hi"]
    for bad in (b"nonsense", record[:-6], record + b"tail"):
        with pytest.raises(ValueError):
            list(warc.parse_records(bad))
