"""Views of the driver's tables that stand in for the stores' logs, and the same views in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.tables import table


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A changelog: seq, ts, key, value (null for a tombstone), deleted, segment and offset within it."""
    e = table(spark, sf_dir, "events")
    deleted = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("seq"), "ts", F.concat(F.lit("key_"), F.lpad(F.col("user_id").cast("string"), 4, "0")).alias("key"),
        F.when(~deleted, F.col("value")).alias("value"), deleted.alias("deleted"), F.floor(F.col("event_id") / 1000).alias("segment_id"), (F.col("event_id") % 1000).alias("offset"),
    )


KV_LOG = """kv_log AS (SELECT event_id AS seq, ts, 'key_' || lpad(user_id::VARCHAR, 4, '0') AS key, CASE WHEN event_type <> 'error' THEN value END AS value,
  event_type = 'error' AS deleted, event_id // 1000 AS segment_id, event_id % 1000 AS "offset" FROM events)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, segment, nation, balance."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))


USERS = "users AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_nationkey AS nation, c_acctbal AS balance FROM customer)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct typed edges between users: from_id, to_id, rel_type."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("from_id"), F.get_json_object("props", "$.k").cast("long").alias("to_id"), F.col("event_type").alias("rel_type")).distinct()


EDGES = "edges AS (SELECT DISTINCT user_id AS from_id, (props->>'$.k')::BIGINT AS to_id, event_type AS rel_type FROM events)"


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions that each write one key: key, value, txn_id, start_ts and commit_ts in microseconds, aborted, deleted."""
    e = table(spark, sf_dir, "events")
    commit = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("user_id").alias("key"), "value", F.col("event_id").alias("txn_id"), (commit - F.floor(F.col("value") * 1_000_000)).cast("long").alias("start_ts"), commit.alias("commit_ts"),
        (F.col("event_type") == "error").alias("aborted"), (F.col("event_type") == "signup").alias("deleted"),
    )


VERSIONS = """versions AS (SELECT user_id AS key, value, event_id AS txn_id, (epoch_us(ts) - floor(value * 1000000))::BIGINT AS start_ts, epoch_us(ts) AS commit_ts,
  event_type = 'error' AS aborted, event_type = 'signup' AS deleted FROM events)"""


def shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows keyed by a string: key, value."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_totalprice").alias("value"))


SHARD_ROWS = "shard_rows AS (SELECT o_orderkey::VARCHAR AS key, o_totalprice AS value FROM orders)"


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered commands: idx, key (one of every ten users), owner, op (the event type), value, t in whole seconds."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("idx"), F.floor(F.col("user_id") / 10).alias("key"), F.col("user_id").alias("owner"), F.col("event_type").alias("op"), F.floor(F.col("value")).cast("long").alias("value"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("t"),
    )


COMMANDS = "commands AS (SELECT event_id AS idx, user_id // 10 AS key, user_id AS owner, event_type AS op, floor(value)::BIGINT AS value, (epoch_us(ts) // 1000000)::BIGINT AS t FROM events)"
