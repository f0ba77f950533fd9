"""Event sources: files of JSON lines, generators, sockets and a queue, as streaming DataFrames of one envelope."""

import json
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: key, value as JSON, event time in seconds.
ENVELOPE = "key string, value string, event_time double"


def parsed(lines: DataFrame) -> DataFrame:
    """Events of JSON lines (column value); unparseable lines are dropped, the processing time is now."""
    event = F.from_json("value", "key string, value variant, event_time double", {"mode": "PERMISSIVE"})
    rows = lines.select(event.alias("e")).where("e is not null and e.event_time is not null")
    return rows.select("e.key", F.to_json("e.value").alias("value"), "e.event_time", F.timestamp_seconds("e.event_time").alias("event_ts"), F.current_timestamp().alias("processing_time"))


def file_source(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the files of JSON lines in a folder, some per trigger, which paces the replay."""
    return parsed(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder))


def socket_source(spark: SparkSession, host: str, port: int) -> DataFrame:
    """A stream of JSON lines from a socket. A development source: it cannot replay what was lost."""
    return parsed(spark.readStream.format("socket").option("host", host).option("port", port).load())


def click_stream(spark: SparkSession, per_second: int = 10, seed: int = 1) -> DataFrame:
    """Clicks of five users on five pages, up to 5 seconds late."""
    r = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    late = F.rand(seed) * 5
    value = F.to_json(F.struct(F.concat(F.lit("/page"), (F.floor(F.rand(seed + 1) * 5) + 1).cast("string")).alias("page"), (F.floor(F.rand(seed + 2) * 60) + 1).alias("duration")))
    return r.select(F.concat(F.lit("user_"), (F.col("value") % 5 + 1).cast("string")).alias("key"), value.alias("value"), F.timestamp_seconds(F.unix_micros("timestamp") / 1e6 - late).alias("event_ts"), F.col("timestamp").alias("processing_time"))


def sensor_stream(spark: SparkSession, sensors: int = 10, per_second: int = 10, seed: int = 2) -> DataFrame:
    """Readings around 20 degrees and 50 percent, up to 2 seconds late."""
    r = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    value = F.to_json(F.struct(F.round(F.randn(seed) * 5 + 20, 2).alias("temperature"), F.round(F.randn(seed + 1) * 10 + 50, 2).alias("humidity")))
    return r.select(F.concat(F.lit("sensor_"), (F.col("value") % sensors).cast("string")).alias("key"), value.alias("value"), F.timestamp_seconds(F.unix_micros("timestamp") / 1e6 - F.rand(seed + 2) * 2).alias("event_ts"), F.col("timestamp").alias("processing_time"))


def transaction_stream(spark: SparkSession, per_second: int = 10, seed: int = 3) -> DataFrame:
    """Amounts between 10 and 1000 on a hundred accounts, up to 3 seconds late."""
    r = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    value = F.to_json(F.struct(F.element_at(F.array(F.lit("deposit"), F.lit("withdrawal"), F.lit("transfer")), (F.floor(F.rand(seed) * 3) + 1).cast("int")).alias("type"), F.round(F.rand(seed + 1) * 990 + 10, 2).alias("amount")))
    return r.select(F.concat(F.lit("account_"), (F.col("value") % 100).cast("string")).alias("key"), value.alias("value"), F.timestamp_seconds(F.unix_micros("timestamp") / 1e6 - F.rand(seed + 2) * 3).alias("event_ts"), F.col("timestamp").alias("processing_time"))


class _GeneratorReader(SimpleDataSourceStreamReader):
    """Batches of a function of the position, so any range can be read again after a failure."""

    def __init__(self, at: Callable[[int], tuple], batch: int, most: int):
        self.at, self.batch, self.most = at, batch, most

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = min(start["n"] + self.batch, self.most)
        return iter([self.at(i) for i in range(start["n"], end)]), {"n": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([self.at(i) for i in range(start["n"], end["n"])])


def generator_source(spark: SparkSession, at: Callable[[int], tuple], batch: int = 100, most: int = 1 << 62) -> DataFrame:
    """A stream of ``at(0), at(1), ...``, tuples of the envelope."""
    name = f"events_{uuid.uuid4().hex[:8]}"

    class Generator(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ENVELOPE

        def simpleStreamReader(self, schema):
            return _GeneratorReader(at, batch, most)

    spark.dataSource.register(Generator)
    return spark.readStream.format(name).load()


class Queue:
    """A queue of events kept as files in a folder that driver and executors share: a put is a new file, and the stream
    reads each file once, also after a restart."""

    def __init__(self, folder: str):
        self.folder, self.n = Path(folder), 0
        self.folder.mkdir(parents=True, exist_ok=True)

    def put(self, key: str, value: object, event_time: float) -> None:
        draft = self.folder / f".{self.n:08}"
        draft.write_text(json.dumps({"key": key, "value": value, "event_time": event_time}) + "\n")
        draft.rename(self.folder / f"{self.n:08}.json")
        self.n += 1

    def stream(self, spark: SparkSession) -> DataFrame:
        return file_source(spark, str(self.folder), 100)


def subscribe(stream: DataFrame, handlers: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """Every micro-batch goes to all handlers; it is read once and kept for them."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for h in handlers:
                h(batch, number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
