"""Log-structured state over the event log."""

from pyspark.sql import functions as F

from lodestream.operators import changelog as cl
from lodestream.plans.views import KV_LOG, kv_log

LATEST = "latest AS (SELECT key, max_by(value, seq) AS value, max(seq) AS seq, max_by(deleted, seq) AS deleted FROM kv_log GROUP BY key)"


def _null_safe(name: str) -> str:
    return f"WITH {KV_LOG}, l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM kv_log {name}) SELECT key, value, seq FROM l WHERE r = 1 AND NOT deleted"


def kv_latest(spark, sf_dir):
    """All live keys."""
    return cl.live(kv_log(spark, sf_dir))


def kv_get(spark, sf_dir):
    """One key."""
    return cl.get(kv_log(spark, sf_dir), "key_0042")


def kv_keys(spark, sf_dir):
    """The live keys alone."""
    return cl.live(kv_log(spark, sf_dir)).select("key")


def kv_multi_get(spark, sf_dir):
    """Live versions of every third user's key."""
    log = kv_log(spark, sf_dir)
    wanted = spark.range(0, 1000, 3).select(F.concat(F.lit("key_"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("key"))
    return cl.multi_get(log, wanted)


def kv_range_closed(spark, sf_dir):
    return cl.range_scan(kv_log(spark, sf_dir), "key_0010", "key_0050")


def kv_range_halfopen(spark, sf_dir):
    return cl.range_scan(kv_log(spark, sf_dir), "key_0010", "key_0050", closed=False)


def kv_stats(spark, sf_dir):
    return cl.stats(kv_log(spark, sf_dir))


def kv_compact(spark, sf_dir):
    """What is left of every segment after compaction."""
    left = cl.compact(kv_log(spark, sf_dir))
    return left.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"), F.max("seq").alias("last_seq"))


def kv_compact_state(spark, sf_dir):
    """The live keys after compaction, which must not change."""
    return cl.live(cl.compact(kv_log(spark, sf_dir)))


def kv_sparse_index(spark, sf_dir):
    return cl.sparse_index(kv_log(spark, sf_dir))


def kv_index_floor(spark, sf_dir):
    keys = spark.createDataFrame([("key_0000",), ("key_0033",), ("key_9999",)], "key string")
    return cl.floor_entries(cl.sparse_index(kv_log(spark, sf_dir)), keys)


def kv_segments_by_size(spark, sf_dir):
    """Segments of 4 KiB of each writer (a key's last digit stands for its writer)."""
    log = kv_log(spark, sf_dir).withColumn("writer", F.substring("key", 8, 1))
    return cl.segments_by_size(log, 4096, "writer").groupBy("writer", "rolled").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


def kv_level_overflow(spark, sf_dir):
    return cl.levels(kv_log(spark, sf_dir))


def kv_compact_level(spark, sf_dir):
    """Changes left by level after the oldest segment of level 0 went into level 1 (four segments a level, by age)."""
    log = kv_log(spark, sf_dir)
    log = log.crossJoin(log.agg(F.max("segment_id").alias("newest")))  # one row
    return cl.compact_level(log, F.expr("(newest - segment_id) div 4"), 0, bottom=False).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"), F.count_if("deleted").alias("tombstones"))


def kv_bloom(spark, sf_dir):
    """A filter of the log's keys, asked for them and for as many keys that are not in it: no key may be missed, and
    not more than one in twenty of the others may pass where one in a hundred is aimed at."""
    keys = kv_log(spark, sf_dir).select("key").distinct()
    filter_ = cl.bloom_filter(keys, 0.01)
    asked = keys.withColumn("there", F.lit(True)).union(keys.select(F.concat("key", F.lit("?")), F.lit(False)))
    said = cl.might_contain(filter_, asked)
    return said.agg(F.count_if("there").alias("keys"), F.count_if(F.col("there") & ~F.col("maybe")).alias("missed"), (20 * F.count_if(~F.col("there") & F.col("maybe")) <= F.greatest(F.count_if(~F.col("there")), F.lit(100))).alias("rate_held"))


def kv_read_at(spark, sf_dir):
    """The record at a place of a segment."""
    return kv_log(spark, sf_dir).where("segment_id = 2 and offset = 17").select("seq", "key", "value", "deleted")


def wal_since_seq(spark, sf_dir):
    log = kv_log(spark, sf_dir)
    return cl.entries_from(log, 500).select("seq", "key", "value", F.when(F.col("deleted"), 2).otherwise(1).alias("op"))


def wal_last_seq(spark, sf_dir):
    """The last number of each segment; -1 of an empty log."""
    return kv_log(spark, sf_dir).agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("last_seq"))


def wal_gaps(spark, sf_dir):
    """Where the changes of a key skip numbers, counted by key."""
    return cl.gaps(kv_log(spark, sf_dir), "key").groupBy("key").agg(F.count(F.lit(1)).alias("gaps"), F.max("missing").alias("widest"))


def wal_apply(spark, sf_dir):
    """State changes of the entries beyond 700, each delivered twice."""
    log = kv_log(spark, sf_dir)
    return cl.apply_entries(log.unionByName(log), 700)


def log_truncate(spark, sf_dir):
    """Terms (segments) and entries of a replicated log after its entries from 800 on are cut off."""
    left = kv_log(spark, sf_dir).where("seq < 800")
    return left.agg(F.max("seq").alias("last_index"), F.max_by("segment_id", "seq").alias("last_term"), F.count(F.lit(1)).alias("entries"))


QUERIES = {f.__name__: f for f in (kv_latest, kv_get, kv_keys, kv_multi_get, kv_range_closed, kv_range_halfopen, kv_stats, kv_compact, kv_compact_state, kv_sparse_index, kv_index_floor, kv_segments_by_size, kv_level_overflow, kv_compact_level, kv_bloom, kv_read_at, wal_since_seq, wal_last_seq, wal_gaps, wal_apply, log_truncate)}
OLD = "old AS (SELECT DISTINCT segment_id FROM kv_log WHERE segment_id < (SELECT max(segment_id) FROM kv_log) ORDER BY 1 LIMIT 2)"
COMPACTED = f"""{OLD}, ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM kv_log WHERE segment_id IN (FROM old)),
c AS (SELECT seq, key, value, deleted, segment_id FROM ranked WHERE r = 1 AND NOT deleted UNION ALL SELECT seq, key, value, deleted, segment_id FROM kv_log WHERE segment_id NOT IN (FROM old))"""
INDEX = "i AS (SELECT segment_id, key, seq, row_number() OVER (PARTITION BY segment_id ORDER BY key, seq)::INT AS place FROM kv_log QUALIFY (place - 1) % 100 = 0)"
ORACLES = {
    "kv_latest": _null_safe(""),
    "kv_get": _null_safe("WHERE key = 'key_0042'"),
    "kv_keys": f"SELECT key FROM ({_null_safe('')})",
    "kv_multi_get": _null_safe("WHERE substr(key, 5)::INT % 3 = 0 AND substr(key, 5)::INT < 1000"),
    "kv_range_closed": _null_safe("WHERE key BETWEEN 'key_0010' AND 'key_0050'"),
    "kv_range_halfopen": _null_safe("WHERE key >= 'key_0010' AND key < 'key_0050'"),
    "kv_stats": f"WITH {KV_LOG} SELECT count(DISTINCT segment_id) AS segments, count(*) AS changes, sum(strlen(key) + 8)::BIGINT AS bytes, (SELECT count(*) FROM ({_null_safe('')})) AS live_keys FROM kv_log",
    "kv_compact": f"WITH {KV_LOG}, {COMPACTED} SELECT segment_id, count(*) AS n, min(key) AS first_key, max(seq) AS last_seq FROM c GROUP BY 1",
    "kv_compact_state": _null_safe(""),
    "kv_sparse_index": f"WITH {KV_LOG}, {INDEX} SELECT * FROM i",
    "kv_index_floor": f"WITH {KV_LOG}, {INDEX}, w AS (SELECT unnest(['key_0000', 'key_0033', 'key_9999']) AS wanted) SELECT segment_id, wanted, max(key) FILTER (key <= wanted) AS floor, min(key) FILTER (key > wanted) AS ceiling FROM i, w GROUP BY ALL",
    "kv_segments_by_size": f"WITH {KV_LOG}, s AS (SELECT seq, substr(key, 8, 1) AS writer, coalesce(sum(strlen(key) + 17) OVER (PARTITION BY substr(key, 8, 1) ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM kv_log) SELECT writer, (b // 4096)::BIGINT AS rolled, count(*) AS n, min(seq) AS first_seq FROM s GROUP BY ALL",
    "kv_level_overflow": f"WITH {KV_LOG}, s AS (SELECT segment_id, sum(strlen(key) + 8)::BIGINT AS bytes FROM kv_log GROUP BY 1), l AS (SELECT least(length(((SELECT max(segment_id) FROM kv_log) - segment_id)::VARCHAR) - 1, 3)::INT AS level, bytes FROM s) SELECT level, sum(bytes)::BIGINT AS bytes, count(*) AS segments, sum(bytes) > 16384 * pow(10, level) AS over FROM l GROUP BY level",
    "kv_compact_level": f"""WITH {KV_LOG}, r AS (SELECT *, ((SELECT max(segment_id) FROM kv_log) - segment_id) // 4 AS level FROM kv_log), o AS (SELECT min(segment_id) AS s FROM r WHERE level = 0),
m AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS k FROM r, o WHERE level = 1 OR (level = 0 AND segment_id = s)),
c AS (SELECT level, seq, deleted FROM r, o WHERE NOT (level = 1 OR (level = 0 AND segment_id = s)) UNION ALL SELECT 1, seq, deleted FROM m WHERE k = 1)
SELECT level, count(*) AS n, max(seq) AS last_seq, count(*) FILTER (deleted) AS tombstones FROM c GROUP BY level""",
    "kv_bloom": f"WITH {KV_LOG} SELECT count(DISTINCT key) AS keys, 0::BIGINT AS missed, true AS rate_held FROM kv_log",
    "kv_read_at": f"WITH {KV_LOG} SELECT seq, key, value, deleted FROM kv_log WHERE segment_id = 2 AND \"offset\" = 17",
    "wal_since_seq": f"WITH {KV_LOG} SELECT seq, key, value, CASE WHEN deleted THEN 2 ELSE 1 END AS op FROM kv_log WHERE seq >= 500",
    "wal_last_seq": f"WITH {KV_LOG} SELECT coalesce(max(seq), -1) AS last_seq FROM kv_log",
    "wal_gaps": f"WITH {KV_LOG}, g AS (SELECT key, seq - lag(seq) OVER (PARTITION BY key ORDER BY seq) - 1 AS missing FROM kv_log) SELECT key, count(*) AS gaps, max(missing) AS widest FROM g WHERE missing > 0 GROUP BY key",
    "wal_apply": f"WITH {KV_LOG}, l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM kv_log WHERE seq > 700) SELECT key, value, seq, deleted FROM l WHERE r = 1",
    "log_truncate": f"WITH {KV_LOG} SELECT max(seq) AS last_index, max_by(segment_id, seq) AS last_term, count(*) AS entries FROM kv_log WHERE seq < 800",
}
