"""Windowed aggregates that run alike over tables and streams; over a stream, lateness is bounded by a watermark."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watermarked(events: DataFrame, ts: str, lateness: str) -> DataFrame:
    return events.withWatermark(ts, lateness) if events.isStreaming else events


def _summed(grouped, value: str) -> DataFrame:
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("total"))


def tumbling(events: DataFrame, key: str, ts: str, value: str, width: str, lateness: str = "5 seconds") -> DataFrame:
    w = F.window(ts, width)
    return _summed(watermarked(events, ts, lateness).groupBy(w, key), value).select(key, F.unix_seconds("window.start").alias("start"), "n", "total")


def sliding(events: DataFrame, key: str, ts: str, value: str, width: str, slide: str, lateness: str = "5 seconds") -> DataFrame:
    w = F.window(ts, width, slide)
    return _summed(watermarked(events, ts, lateness).groupBy(w, key), value).select(key, F.unix_seconds("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, key: str, ts: str, value: str, gap: str, lateness: str = "5 seconds") -> DataFrame:
    w = F.session_window(ts, gap)
    return _summed(watermarked(events, ts, lateness).groupBy(w, key), value).select(key, F.unix_micros("session_window.start").alias("start"), "n", "total")


def late(events: DataFrame, event_ts: str, arrival_ts: str, lateness: float) -> DataFrame:
    """Events that arrive later than ``lateness`` seconds after they happened."""
    return events.where(F.unix_micros(arrival_ts) - F.unix_micros(event_ts) > F.lit(int(lateness * 1e6)))
