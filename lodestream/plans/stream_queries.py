"""Event streams: the replay's pace, and windows over the event log as the streaming queries compute them."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestream.streaming import windows as wi
from lodestream.tables import table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_replay_delay(spark, sf_dir):
    """How long a replay at ten times the speed waits before each event of its file (a day)."""
    e = _events(spark, sf_dir).select("event_id", F.to_date("ts").alias("day"), F.unix_micros("ts").alias("t"))
    before = F.lag("t").over(W.partitionBy("day").orderBy("t", "event_id"))
    return e.select("event_id", F.greatest(F.lit(0), F.coalesce(F.col("t") - before, F.lit(0))).alias("gap")).select("event_id", F.floor(F.col("gap") / 10).alias("delay"))


def stream_parsed(spark, sf_dir):
    """Events of JSON lines, of which some cannot be parsed."""
    from lodestream.sources.events import parsed

    e = table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("user_id").cast("string").alias("key"), F.struct(F.col("event_type").alias("type")).alias("value"), F.col("event_id").cast("double").alias("event_time"))))
    return parsed(e.select(line.alias("value"))).select("key", F.get_json_object("value", "$.type").alias("type"), "event_time")


def stream_tumbling(spark, sf_dir):
    return wi.tumbling(_events(spark, sf_dir), "event_type", "ts", "value", "1 hour")


def stream_sliding(spark, sf_dir):
    return wi.sliding(_events(spark, sf_dir), "event_type", "ts", "value", "2 hours", "1 hour")


def stream_session(spark, sf_dir):
    return wi.sessions(_events(spark, sf_dir), "user_id", "ts", "value", "6 hours")


def stream_late_drop(spark, sf_dir):
    """Events that are more than five seconds late, by type; an event's value stands for its lateness in seconds."""
    e = _events(spark, sf_dir).withColumn("arrival", F.timestamp_micros(F.unix_micros("ts") + F.floor(F.col("value") * 1_000_000)))
    return wi.late(e, "ts", "arrival", 5.0).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (stream_replay_delay, stream_parsed, stream_tumbling, stream_sliding, stream_session, stream_late_drop)}
SUMMED = "count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total"
ORACLES = {
    "stream_replay_delay": "SELECT event_id, floor(greatest(0, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY ts::DATE ORDER BY ts, event_id), 0)) / 10)::BIGINT AS delay FROM events",
    "stream_parsed": "SELECT user_id::VARCHAR AS key, event_type AS type, event_id::DOUBLE AS event_time FROM events WHERE event_id % 7 <> 0",
    "stream_tumbling": f"SELECT event_type, (epoch_us(ts) // 3600000000) * 3600 AS start, {SUMMED} FROM events GROUP BY 1, 2",
    "stream_sliding": f"SELECT event_type, start, {SUMMED} FROM (SELECT *, unnest([(epoch_us(ts) // 3600000000) * 3600, (epoch_us(ts) // 3600000000) * 3600 - 3600]) AS start FROM events) GROUP BY 1, 2",
    "stream_session": f"WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 21600000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(epoch_us(ts)) AS start, {SUMMED} FROM s GROUP BY user_id, s",
    "stream_late_drop": "SELECT event_type, count(*) AS n FROM events WHERE floor(value * 1000000) > 5000000 GROUP BY 1",
}
