"""Content-addressed WARC archive.

``write_archive`` keeps each distinct payload once, under its SHA-256, and the exact header bytes of every record
(WARC fields and the HTTP head) in a table of their own. ``read_archive`` joins the two again and gives back the
original records byte by byte. A digest counts only when verified: on writing, rows that share a SHA-256 must agree
on SHA-1 and length; on reading, the stored bytes are hashed again, and every rebuilt record's block must have the
length and the digest that its own header names. ``write_files`` puts records into WARC files, ``read_files`` reads them.

A payload that very many records share is looked up under ``SALTS`` copies of its row. Such payloads are those with more
than one in ``HOT_SHARE`` of all records, so there are at most HOT_SHARE of them.

Defined cases: a null payload is an empty one; repeated rows (same id, same payload) are the same record and get the
same type; a null id is smaller than any other; other columns of the input are ignored, whatever their names; an
empty table gives an empty archive. No payload is cut, whatever its length.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import fresh_path, read, ship

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
HOT_SHARE, SALTS = 500, 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """Folders of the two tables."""

    payloads: str
    headers: str


def base32(hex40: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: five of them are 20 bits, or four base32 digits."""
    parts = [F.lpad(F.conv(F.substring(hex40, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _named(id_: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(id_.cast("string"), F.lit("none")), F.lit(">"))


def _http_head() -> Column:
    return F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))


def _header(kind: Column) -> Column:
    """The record's bytes before its payload."""
    head = _http_head()
    digest = F.when(kind == "response", F.col("block_sha1")).otherwise(base32(F.sha1(F.encode(head, "UTF-8"))))
    block = F.when(kind == "response", F.octet_length(head) + F.col("bytes")).otherwise(F.octet_length(head))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind, F.lit(f"{CRLF}WARC-Record-ID: "), _named(F.col("id")),
        F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", " "),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("sha1"), F.lit(f"{CRLF}WARC-Block-Digest: sha1:"), digest,
        F.when(kind == "revisit", F.concat(F.lit(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), _named(F.col("owner")))).otherwise(""),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), block.cast("string"), F.lit(CRLF + CRLF), head,
    )


def _salted(records: DataFrame, store: DataFrame) -> DataFrame:
    """Records (id, digest, ...) joined to the rows of the store (digest, n, ...) by digest."""
    total = store.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(store.where(F.col("n") * HOT_SHARE > max(total, 1000 * HOT_SHARE)).select("digest", F.lit(SALTS).alias("_salts")))  # at most HOT_SHARE rows
    salts = F.coalesce("_salts", F.lit(1))
    left = records.join(hot, "digest", "left").withColumn("_salt", F.pmod(F.xxhash64("id"), salts).cast("int")).drop("_salts")
    right = store.join(hot, "digest", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts", "n")
    return left.join(right, ["digest", "_salt"]).drop("_salt")


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> Archive:
    """Write a record per row. Among equal payloads of ``least_bytes`` or more, the one with the largest id is the
    response and the others revisit it; smaller payloads are all responses."""
    spark = pages.sparkSession
    out = Archive(fresh_path(spark, "payloads"), fresh_path(spark, "headers"))
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    records = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumns(
        {"digest": F.sha2("payload", 256), "sha1": base32(F.sha1("payload")), "bytes": F.octet_length("payload").cast("long")}
    )
    blocks = records.withColumn("block_sha1", base32(F.sha1(F.concat(F.encode(_http_head(), "UTF-8"), "payload")))).drop("payload")
    # One row per digest leaves each task, so a payload that a third of all pages share is no hot key here.
    store = records.groupBy("digest").agg(
        F.first("payload").alias("payload"), F.max("id").alias("owner"), F.min("sha1").alias("sha1"), F.max("sha1").alias("sha1_too"), F.min("bytes").alias("bytes"), F.max("bytes").alias("bytes_too"), F.count(F.lit(1)).alias("n"),
    )
    same = (F.col("sha1") == F.col("sha1_too")) & (F.col("bytes") == F.col("bytes_too"))
    store.withColumn("bytes", F.when(same, F.col("bytes")).otherwise(F.raise_error(F.concat(F.lit("different payloads share the digest "), F.col("digest"))).cast("long"))).select("digest", "payload", "owner", "bytes", "n").write.parquet(out.payloads)
    owners = spark.read.parquet(out.payloads).select("digest", "owner", "n")
    kind = F.when((F.col("bytes") < least_bytes) | F.col("id").eqNullSafe(F.col("owner")), "response").otherwise("revisit")
    _salted(blocks, owners).select("id", "digest", F.encode(_header(kind), "UTF-8").alias("header")).write.parquet(out.headers)
    return out


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """The records: id, header, payload (also of what a revisit refers to), record (the original bytes, checked against
    the length and the digest that its header names), with the length and the SHA-1 of the stored bytes after a check
    of their SHA-256."""
    held = F.sha2("payload", 256) == F.col("digest")
    store = spark.read.parquet(archive.payloads).select(
        "digest", "n", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(held, base32(F.sha1("payload"))).otherwise(F.raise_error(F.concat(F.lit("stored bytes do not have the digest "), F.col("digest")))).alias("payload_digest"),
    )
    head = F.decode("header", "UTF-8")
    kind = F.regexp_extract(head, "\r\nWARC-Type: (\\w+)\r\n", 1)
    body = F.when(kind == "response", F.col("payload")).otherwise(F.lit(b""))
    whole = F.concat("header", body)
    start = F.octet_length(F.substring_index(head, CRLF + CRLF, 1)) + 4
    said = F.regexp_extract(head, "\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: ([0-9]+)\r\n\r\n", 1).cast("long")
    block_digest = F.regexp_extract(head, "\r\nWARC-Block-Digest: sha1:(\\w+)\r\n", 1)
    block = F.substring(whole, start + 1, F.octet_length(whole) - start)
    true = (F.octet_length(block) == said) & (base32(F.sha1(block)) == block_digest)
    return (
        _salted(spark.read.parquet(archive.headers), store)
        .withColumns({"record_type": kind, "refers_to": F.expr(r"try_cast(nullif(regexp_extract(decode(header, 'UTF-8'), '\r\nWARC-Refers-To: <urn:page:(-?[0-9]+)>\r\n', 1), '') as bigint)"), "said_digest": F.regexp_extract(head, "\r\nWARC-Payload-Digest: sha1:(\\w+)\r\n", 1)})
        .withColumn("record", F.when(true, F.concat("header", body, F.lit((CRLF + CRLF).encode()))).otherwise(F.raise_error(F.lit("a record is not as long as its header says, or has another digest")).cast("binary")))
    )


def write_files(records: DataFrame, folder: str, most_records: int = 100_000) -> None:
    """The records (a column record) as WARC files in a folder, uncompressed, up to ``most_records`` in a file."""
    body = F.expr("substring(record, 1, octet_length(record) - 4)")  # the end of a record is the writer's line end
    records.select(body.cast("string").alias("value")).write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", most_records).text(folder)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(fields, block, whole record) of every record of a WARC file; raises ValueError where the file is cut off."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in data[at:end].decode().split(CRLF)[1:])
        stop = end + 4 + int(fields["Content-Length"])
        if end < 0 or data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield fields, data[end + 4 : stop], data[at : stop + 4]
        at = stop + 4


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Of every record of a folder's WARC files: record_id, record_type, uri, refers_to, payload_digest, block and record.
    A file is one task's, so its size is what ``write_files`` bounds."""
    ship(spark)
    names = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                for fields, block, record in parse(content.as_py()):
                    values = [fields.get(f) for f in names.values()]
                    yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.string()) for v in values), pa.array([block], pa.binary()), pa.array([record], pa.binary())], [*names, "block", "record"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(turn, ", ".join([*(f"{n} string" for n in names), "block binary", "record binary"]))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, read the archive back, and describe every record from what was read."""
    records = read_archive(spark, write_archive(read(spark, sf_dir, "pages")))
    agreed = F.when(F.col("payload_digest") == F.col("said_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header names another digest than its payload has")))
    return records.select(F.col("id").alias("page_id"), "payload_bytes", agreed.alias("payload_digest"), "record_type", "refers_to", F.octet_length("record").cast("long").alias("record_bytes"))


#: The header as SQL; two letters stand for each line end, since only its length is asked for.
_LINES = f"""('WARC/1.1xxWARC-Type: ' || record_type || 'xxWARC-Record-ID: <urn:page:' || page_id || '>xxWARC-Date: {DATE}xxWARC-Target-URI: ' || url
  || 'xxWARC-Payload-Digest: sha1:' || payload_digest || 'xxWARC-Block-Digest: sha1:' || payload_digest
  || CASE WHEN record_type = 'revisit' THEN 'xxWARC-Profile: {PROFILE}xxWARC-Refers-To: <urn:page:' || refers_to || '>' ELSE '' END
  || 'xxContent-Type: application/http; msgtype=responsexxContent-Length: ' || block || 'xxxx')"""
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(coalesce(url, ''), '[\r\n]', ' ', 'g') AS url FROM pages),
d AS (SELECT page_id, url, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS owner FROM p),
r AS (SELECT page_id, payload_bytes, url,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM d),
b AS (SELECT *, strlen('HTTP/1.1 200 OKxxContent-Type: text/html; charset=utf-8xxContent-Length: ' || payload_bytes || 'xxxx') + CASE WHEN record_type = 'response' THEN payload_bytes ELSE 0 END AS block FROM r)
SELECT page_id, payload_bytes, payload_digest, record_type, refers_to, (strlen(""" + _LINES + """) + block + 4)::BIGINT AS record_bytes FROM b
"""
QUERIES = {"op2_warc": op2_warc}
ORACLES = {"op2_warc": ORACLE_SQL}
