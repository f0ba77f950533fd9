"""Binary log files: key/value segments and write-ahead logs.

A segment record is key length, value length and a deleted flag (big-endian, 4 + 4 + 1 bytes), then key and value. A
write-ahead entry is number, operation (1 put, 2 delete), key length, value length and time (8 + 1 + 4 + 4 + 8 bytes),
then key and value; an entry's value is present for a put, also if empty. A file that ends in the middle of a record
holds what comes before it. Files are read whole, one per row, as segments have a bounded size."""

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.shipping import ship_package

# Record headers.
SEGMENT, ENTRY = struct.Struct(">IIB"), struct.Struct(">QBIId")
PUT, DELETE = 1, 2


def segment_record(key: str, value: str | None) -> bytes:
    k, v = key.encode(), (value or "").encode()
    return SEGMENT.pack(len(k), len(v), value is None) + k + v


def wal_entry(seq: int, op: int, key: str, value: str | None, ts: float) -> bytes:
    k, v = key.encode(), (value or "").encode()
    return ENTRY.pack(seq, op, len(k), len(v), ts) + k + v


def segment_rows(data: bytes) -> Iterator[tuple[int, str, str | None, bool]]:
    """(offset, key, value, deleted) in file order."""
    at = 0
    while at + SEGMENT.size <= len(data):
        n, m, deleted = SEGMENT.unpack_from(data, at)
        end = at + SEGMENT.size + n + m
        if end > len(data):
            return
        key = data[at + SEGMENT.size : at + SEGMENT.size + n].decode()
        yield at, key, None if deleted else data[end - m : end].decode(), bool(deleted)
        at = end


def wal_rows(data: bytes) -> Iterator[tuple[int, int, str, str | None, float]]:
    """(seq, op, key, value, ts) in file order."""
    at = 0
    while at + ENTRY.size <= len(data):
        seq, op, n, m, ts = ENTRY.unpack_from(data, at)
        end = at + ENTRY.size + n + m
        if end > len(data):
            return
        yield seq, op, data[at + ENTRY.size : at + ENTRY.size + n].decode(), data[end - m : end].decode() if op == PUT else None, ts
        at = end


#: Entries in a write-ahead file.
ENTRIES = 10_000


def _write(rows: DataFrame, folder: str, key: str, record, most: int) -> None:
    """A file for each run of rows with the same key, in their order, of ``most`` rows at most. A file is one line of a
    text file; the byte that ends the line is shorter than any record's header, so readers stop before it."""
    ship_package(rows.sparkSession)
    at = rows.columns.index(key)
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, n = None, bytearray(), 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if n and (row[at] != held or n == most):
                    yield pa.RecordBatch.from_arrays([pa.array([held], b.column(at).type), pa.array([bytes(out)], pa.binary())], [key, "data"])
                    out, n = bytearray(), 0
                held, n = row[at], n + 1
                out += record(row)
            kept = b.column(at).type
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([held], kept), pa.array([bytes(out)], pa.binary())], [key, "data"])

    made = rows.mapInArrow(run, f"{key} {kind}, data binary").select(key, F.col("data").cast("string").alias("value"))
    made.write.option("maxRecordsPerFile", 1).partitionBy(key).text(folder)


def write_segments(log: DataFrame, folder: str) -> None:
    """A changelog (segment_id, seq, key, value or null, deleted) as a file per segment, in folders segment_id=N."""
    rows = log.select(F.col("segment_id").cast("long"), "seq", "key", "value", "deleted").repartition("segment_id").sortWithinPartitions("segment_id", "seq")
    _write(rows, folder, "segment_id", lambda r: segment_record(r[2], None if r[4] else r[3]), 1 << 62)


def write_wal(entries: DataFrame, folder: str) -> None:
    """Entries (seq, op, key, value, t in seconds) as write-ahead files of up to ENTRIES entries, by ranges of seq."""
    rows = entries.select(F.floor(F.col("seq") / ENTRIES).alias("part"), "seq", "op", "key", "value", "t").repartition("part").sortWithinPartitions("part", "seq")
    _write(rows, folder, "part", lambda r: wal_entry(r[1], r[2], r[3], r[4], r[5]), ENTRIES)


def _files(spark: SparkSession, folder: str, rows, schema: str) -> DataFrame:
    ship_package(spark)
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, data in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame([(path, *r) for r in rows(bytes(data))], columns=["path", *names])

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInPandas(run, f"path string, {schema}")


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """path, segment_id (of the file's folder segment_id=N, else the digits of its name), offset, key, value, deleted, and
    seq, their common order."""
    rows = _files(spark, folder, segment_rows, "offset long, key string, value string, deleted boolean")
    number = F.coalesce(F.nullif(F.regexp_extract("path", r"/segment_id=(\d+)/", 1), F.lit("")), F.regexp_extract("path", r"(\d+)[^/]*$", 1))
    return rows.withColumn("segment_id", number.cast("long")).withColumn("seq", F.struct("segment_id", "offset"))


def read_wal(spark: SparkSession, folder: str) -> DataFrame:
    """seq, op, key, value, ts."""
    return _files(spark, folder, wal_rows, "seq long, op int, key string, value string, ts double").drop("path")
