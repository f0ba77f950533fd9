"""Streams over files give what the same computation gives over the table."""

import json

from pyspark.sql import functions as F

from lodestream.sources import events as src
from lodestream.streaming import windows as wi


def drained(stream, name, folder, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/c_{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_file_source_drops_what_it_cannot_parse(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"key": f"k{k}", "value": {"n": k}, "event_time": 1.5 + k}) + "\n{broken\n")
    rows = drained(src.file_source(spark, str(tmp_path / "in")), "files", tmp_path).collect()
    assert sorted((r.key, r.value, r.event_time) for r in rows) == [(f"k{k}", f'{{"n":{k}}}', 1.5 + k) for k in range(3)]


def test_queue_delivers_each_event_once(spark, tmp_path):
    q = src.Queue(str(tmp_path / "queue"))
    q.put("a", {"n": 1}, 1.0)
    first = drained(q.stream(spark), "queue_one", tmp_path).count()
    q.put("b", [2], 2.0)
    q.put("c", "x", 3.0)
    assert first == 1 and drained(q.stream(spark), "queue_two", tmp_path).count() == 3


def test_generator_and_subscribers(spark, tmp_path):
    stream = src.generator_source(spark, lambda i: (f"k{i % 3}", str(i), float(i)), batch=40, most=100)
    seen = {"count": 0, "sum": 0.0}

    def count(batch, _):
        seen["count"] += batch.count()

    def total(batch, _):
        seen["sum"] += batch.agg(F.coalesce(F.sum("event_time"), F.lit(0.0))).first()[0]

    q = src.subscribe(stream, [count, total], str(tmp_path / "c")).trigger(processingTime="0 seconds").start()
    try:
        for _ in range(100):
            if seen["count"] >= 100 and seen["sum"] >= 4950.0:
                break
            q.awaitTermination(0.3)
    finally:
        q.stop()
    assert seen == {"count": 100, "sum": 4950.0}


def test_generated_streams(spark, tmp_path):
    for k, stream in enumerate((src.click_stream(spark), src.sensor_stream(spark, 3), src.transaction_stream(spark))):
        assert {"key", "value", "event_ts", "processing_time"} == set(stream.columns)
        q = stream.writeStream.format("memory").queryName(f"made_{k}").trigger(processingTime="0 seconds").start()
        q.awaitTermination(3)
        q.stop()
        rows = spark.table(f"made_{k}").collect()
        assert all(json.loads(r.value) and r.event_ts <= r.processing_time for r in rows)


def test_tumbling_stream_equals_table(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    table.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "t"))
    got = {tuple(r) for r in drained(wi.tumbling(stream, "event_type", "ts", "value", "1 day"), "tumbling", tmp_path, "update").collect()}
    assert got == {tuple(r) for r in wi.tumbling(table, "event_type", "ts", "value", "1 day").collect()}


def test_streaming_fold_equals_the_batch_fold(spark, tmp_path):
    from lodestream.operators import folds as fo
    from lodestream.plans.views import commands
    from lodestream.streaming.state import fold_stream

    table = commands(spark, "/root/testdata/sf0.001")
    for k in range(3):  # files of consecutive commands
        table.where(f"idx % 900 div 300 = {k} and idx < 900").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    schema = "allowed boolean, mode int"
    got = {tuple(r) for r in drained(fold_stream(stream, "key", "idx", fo.breaker_step, schema), "fold", tmp_path).collect()}
    assert got == {tuple(r) for r in fo.ordered_fold(table.where("idx < 900"), "key", "idx", fo.breaker_step, schema).collect()}
