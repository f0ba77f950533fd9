import base64
import hashlib

from pyspark.sql import functions as F

from lodestream.llm import warc
from lodestream.llm.common import read


def brute(rows):
    largest = {}
    for i, html in rows:
        h = (html or "").encode()
        largest[h] = i if h not in largest or largest[h] is None else max(largest[h], i if i is not None else largest[h])
    out = set()
    for i, html in rows:
        h = (html or "").encode()
        own = largest[h] == i
        out.add((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if own else "revisit", None if own else largest[h]))
    return out


def test_whole_table(spark, small):
    rows = [(r.page_id, r.html) for r in read(spark, small, "pages").collect()]
    got = warc.op2_warc(spark, small).collect()
    assert {tuple(r)[:5] for r in got} == brute(rows) and len(got) == len(rows)


def test_round_trip_and_edges(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (4, "http://b/\r\nWARC-Type: forged", "<p>x</p>"), (2, None, None), (3, "http://c/", ""), (9, "http://d/", "WARC/1.1\r\n\r\n"), (7, "http://e/", "é" * 100_000), (9, "http://d/", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("clash"), "id": F.lit(0)})
    archive = warc.write_archive(pages)
    got = warc.read_archive(spark, archive).collect()
    assert {(r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == brute([(i, h) for i, _, h in rows])
    assert len(got) == len(rows)
    assert spark.read.parquet(archive.payloads).count() == 4  # each payload once
    for r in got:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        block = rest[: int(fields[b"Content-Length"])]
        assert rest[len(block) :] == b"\r\n\r\n"
        http, _, body = block.partition(b"\r\n\r\n")
        assert body == (bytes(r.payload) if r.record_type == "response" else b"")
        assert b"Content-Length: %d" % r.payload_bytes in http


def test_least_bytes_and_empty(spark):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc")], "page_id long, url string, html string")
    kinds = [r.record_type for r in warc.read_archive(spark, warc.write_archive(pages, least_bytes=4)).collect()]
    assert kinds == ["response", "response"]
    assert warc.read_archive(spark, warc.write_archive(pages.limit(0))).count() == 0


def test_null_ids_and_a_hot_payload(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_SHARE", 0.001)  # so that a few rows are many
    rows = [(None, "u", "same"), (None, "u", "same"), (None, "u", "alone")] + [(k, "u", "same" if k % 3 else f"own {k}") for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_archive(spark, warc.write_archive(pages)).collect()
    assert len(got) == len(rows)
    assert {(r.id, r.record_type, r.refers_to) for r in got if bytes(r.payload) == b"same"} == {(59, "response", None)} | {(i, "revisit", 59) for i, _, h in rows if h == "same" and i != 59}
    only = spark.createDataFrame([(None, "u", "x"), (None, "v", "x")], "page_id long, url string, html string")
    assert [r.record_type for r in warc.read_archive(spark, warc.write_archive(only)).collect()] == ["response"] * 2


def test_files(spark, tmp_path):
    rows = [(1, "http://a/\u00e9", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, ""), (4, "http://c/", "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n"), (5, "http://d/", "\u4e16\u754c" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    records = warc.read_archive(spark, warc.write_archive(pages)).select("record")
    warc.write_files(records, str(tmp_path / "w"), 2)
    got = warc.read_files(spark, str(tmp_path / "w")).collect()
    assert {bytes(r.record) for r in got} == {bytes(r.record) for r in records.collect()} and len(got) == len(rows)
    assert {(r.record_id, r.record_type, r.refers_to) for r in got} == {("<urn:page:1>", "revisit", "<urn:page:2>"), ("<urn:page:2>", "response", None), ("<urn:page:3>", "response", None), ("<urn:page:4>", "response", None), ("<urn:page:5>", "response", None)}
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    assert len(list(warc.parse(whole))) == len(rows)
    import pytest

    with pytest.raises(ValueError):
        list(warc.parse(whole[:-3]))
