"""Replication, counters, detectors and load statistics over the event log."""

from pyspark.sql import functions as F

from lodestream.operators import replication as rp
from lodestream.plans.views import KV_LOG, kv_log
from lodestream.tables import table

def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)


def replication_lag(spark, sf_dir):
    """Followers 0 to 2 apply a prefix each; follower 3 has nothing."""
    log = kv_log(spark, sf_dir).select("seq", F.substring("key", 5, 4).cast("long").alias("user"))
    followers = log.select((F.col("user") % 3).alias("follower"), "seq").where("seq % 10 >= follower")
    return rp.lag(log, followers, spark.range(4).withColumnRenamed("id", "follower"))


def quorum_ack(spark, sf_dir):
    """An order's lines stand for followers; accepted lines acknowledge."""
    acks = table(spark, sf_dir, "lineitem")
    return rp.quorum(acks, "l_orderkey", F.col("l_returnflag") != "R", F.floor(F.col("followers") / 2) + 1)


def replica_entries(spark, sf_dir):
    """Entries from a number on, by replica: what a fetch returns."""
    log = kv_log(spark, sf_dir).where("seq >= 300")
    return log.groupBy((F.col("seq") % 3).alias("replica")).agg(F.count(F.lit(1)).alias("entries"), F.max("seq").alias("applied_seq"))


def _last_seen(spark, sf_dir):
    e = _events(spark, sf_dir)
    last = e.groupBy(F.col("user_id").alias("node")).agg(F.max("t").alias("last"))
    return last.crossJoin(e.agg(F.max("t").alias("now")))


def peer_alive(spark, sf_dir):
    return _last_seen(spark, sf_dir).select("node", (F.col("now") - F.col("last") <= 20_000).alias("alive"))


def elect_min_alive(spark, sf_dir):
    """The least node that is alive leads."""
    return peer_alive(spark, sf_dir).where("alive").agg(F.min("node").alias("leader"))


def _counters(spark, sf_dir):
    """States of grow-only counters as replicas know them: node, replica, increments and decrements so far."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 5).alias("node"), (F.col("event_id") % 3).alias("replica"), F.col("event_id").alias("inc"), F.floor(F.col("event_id") / 2).alias("dec"))


def gcounter_merge(spark, sf_dir):
    merged = rp.max_per_node(_counters(spark, sf_dir), ["node"], ["inc"])
    return merged.agg(F.sum("inc").alias("value"), F.count(F.lit(1)).alias("nodes"))


def pncounter_merge(spark, sf_dir):
    return rp.max_per_node(_counters(spark, sf_dir), ["node"], ["inc", "dec"]).agg((F.sum("inc") - F.sum("dec")).alias("value"))


def vector_clock_merge(spark, sf_dir):
    return rp.max_per_node(_counters(spark, sf_dir), ["node"], ["inc"]).select("node", F.col("inc").alias("clock"))


def counter_ops(spark, sf_dir):
    """Increments (purchases) and decrements (errors) of each node and its clock."""
    e = table(spark, sf_dir, "events").where("event_type in ('purchase', 'error')")
    delta = F.when(F.col("event_type") == "purchase", 1).otherwise(-1)
    return e.groupBy((F.col("user_id") % 5).alias("node")).agg(F.sum(delta).alias("counter"), F.count(F.lit(1)).alias("clock"))


def phi_accrual(spark, sf_dir):
    """Suspicion of each node at the end of the log, from its last 100 intervals; null with fewer than two."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("node"), "t")
    stats = rp.heartbeats(e, "node", "t", 100).groupBy("node").agg(F.max_by(F.struct("mean", "dev", "n", "t"), "t").alias("s"))
    now = e.agg(F.max("t").alias("now"))
    dev = F.greatest(F.col("s.dev"), F.lit(0.5))
    return stats.crossJoin(now).select("node", F.when(F.col("s.n") >= 2, F.round(rp.phi(F.col("now") - F.col("s.t"), F.col("s.mean"), dev), 3)).alias("phi"))


def gossip_status(spark, sf_dir):
    return _last_seen(spark, sf_dir).select("node", rp.age_status(F.col("now"), F.col("last"), 5000, 15_000).alias("status"))


def gossip_counters(spark, sf_dir):
    """Each node's greatest counter, and when it first stood at it: what merged gossip keeps."""
    e = _events(spark, sf_dir).select((F.col("user_id") % 5).alias("node"), F.col("event_id").alias("inc"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    best = e.groupBy("node").agg(F.max(F.struct("inc", (-F.col("at")).alias("before"))).alias("b"))
    return best.select("node", F.col("b.inc").alias("counter"), (-F.col("b.before")).alias("rose_at"))


def split_brain(spark, sf_dir):
    """Customers as nodes, an order's priority as the network and its state as the side that a node is seen on."""
    o = table(spark, sf_dir, "orders")
    return rp.sides_with_quorum(o.select(F.col("o_orderpriority").alias("network"), F.col("o_orderstatus").alias("side"), F.col("o_custkey").alias("node")))


def partition_pairs(spark, sf_dir):
    """Pairs that a partition between two groups of nations separates, as unordered pairs."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    a, b = n.where("n_regionkey = 0").select(F.col("n_nationkey").alias("a")), n.where("n_regionkey = 1").select(F.col("n_nationkey").alias("b"))
    return a.crossJoin(b).select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))  # both are parts of a table of 25 rows


def latency_stats(spark, sf_dir):
    """Requests by outcome, success rate, mean and percentiles of latency, per hour of the day."""
    e = _events(spark, sf_dir).withColumn("hour", F.hour("ts"))
    ok = F.col("event_type") != "error"
    totals = e.groupBy("hour").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("ok"), (F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("mean"))
    ranks = rp.nearest_rank(e, ["hour"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return totals.join(ranks, "hour").select("hour", "total", "ok", (F.col("ok") / F.col("total")).alias("rate"), "mean", "p50", "p95", "p99")


def slow_tasks(spark, sf_dir):
    """Running tasks (errors) that take more than 1.5 times the mean of those completed."""
    e = table(spark, sf_dir, "events")
    mean = e.where("event_type <> 'error'").agg((F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("mean"))
    return e.where("event_type = 'error'").crossJoin(mean).where(F.col("value") > 1.5 * F.col("mean")).select("event_id", "value")


def task_status(spark, sf_dir):
    """Tasks by state and attempts."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("state"), (F.col("event_id") % 3).alias("attempt")).agg(F.count(F.lit(1)).alias("tasks"))


def raft_votes(spark, sf_dir):
    """Votes granted: a candidate's log must be as new as the voter's, by last term and then by length."""
    logs = kv_log(spark, sf_dir).groupBy((F.col("seq") % 5).alias("node")).agg(F.max("segment_id").alias("last_term"), F.count(F.lit(1)).alias("last_index"))
    c, v = (logs.select(F.col("node").alias(n), F.struct("last_term", "last_index").alias(f"{n}_log")) for n in ("candidate", "voter"))
    return c.crossJoin(v).where("candidate <> voter").select("candidate", "voter", (F.col("candidate_log") >= F.col("voter_log")).alias("granted"))  # five nodes


def _terms(spark, sf_dir):
    """The log as entries idx with a term for every hundred, and the last idx."""
    log = kv_log(spark, sf_dir).select(F.col("seq").alias("idx"), F.floor(F.col("seq") / 100).alias("term"))
    return log.crossJoin(log.agg(F.max("idx").alias("top")))  # one row


def raft_append(spark, sf_dir):
    """A follower's log after a leader's entries (from two to three fifths of the log): conflicts, which begin in the
    middle, are cut off, what was sent stands."""
    log = _terms(spark, sf_dir)
    mine = log.withColumn("term", F.when(2 * F.col("idx") >= F.col("top"), F.col("term") + 7).otherwise(F.col("term")))
    return rp.append_entries(mine.drop("top"), log.where("5 * idx between 2 * top and 3 * top").drop("top"))


def raft_commit_index(spark, sf_dir):
    """Four followers hold a prefix of the log each, up to the last entry that each has acknowledged."""
    log = _terms(spark, sf_dir).drop("top")
    match = log.where("idx % 10 >= idx % 4").groupBy((F.col("idx") % 4).alias("follower")).agg(F.max("idx").alias("idx"))
    return rp.commit_index(match, log, 5)


def raft_apply(spark, sf_dir):
    """State after the committed entries (nine tenths of the log) beyond those applied (six tenths)."""
    from lodestream.operators.changelog import apply_entries

    log = kv_log(spark, sf_dir)
    log = log.crossJoin(log.agg(F.max("seq").alias("top")))  # one row
    return apply_entries(log.where("10 * seq <= 9 * top"), F.expr("6 * top div 10"))


def snapshot_due(spark, sf_dir):
    """Whether the log beyond its last snapshot (entry 500) is longer than 1000 entries."""
    return kv_log(spark, sf_dir).agg(F.max("seq").alias("last_index"), (F.max("seq") - 500 > 1000).alias("due"))


def session_guarantees(spark, sf_dir):
    """Reads of a user's session that would go back behind what it has already seen (monotonic reads)."""
    from pyspark.sql import Window as W

    log = kv_log(spark, sf_dir).select("key", "seq", (F.col("seq") * 7919 % 1000).alias("replica_seq"))
    seen = F.max("replica_seq").over(W.partitionBy("key").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    return log.withColumn("seen", seen).groupBy("key").agg(F.count_if(F.col("replica_seq") < F.col("seen")).alias("stale"), F.count(F.lit(1)).alias("reads"))


QUERIES = {f.__name__: f for f in (replication_lag, quorum_ack, replica_entries, peer_alive, elect_min_alive, gcounter_merge, pncounter_merge, vector_clock_merge, counter_ops, phi_accrual, gossip_status, gossip_counters, split_brain, partition_pairs, latency_stats, slow_tasks, task_status, raft_votes, raft_append, raft_commit_index, raft_apply, snapshot_due, session_guarantees)}
T = "epoch_us(ts) / 1000000"
SEEN = f"s AS (SELECT user_id AS node, max({T}) AS last, (SELECT max({T}) FROM events) AS now FROM events GROUP BY 1)"
COUNTERS = "c AS (SELECT user_id % 5 AS node, event_id % 3 AS replica, event_id AS inc, event_id // 2 AS dec FROM events)"
ALIVE = f"WITH {SEEN} SELECT node, now - last <= 20000 AS alive FROM s"
ORACLES = {
    "replication_lag": f"WITH {KV_LOG}, f AS (SELECT substr(key, 5, 4)::BIGINT % 3 AS follower, seq FROM kv_log) SELECT r.range AS follower, (SELECT max(seq) FROM kv_log) - coalesce(max(f.seq), -1) AS lag FROM range(4) r LEFT JOIN (FROM f WHERE seq % 10 >= follower) f ON f.follower = r.range GROUP BY 1",
    "quorum_ack": "SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') + 1 AS acks, count(*) AS followers, count(*) FILTER (l_returnflag <> 'R') + 1 >= count(*) // 2 + 1 AS committed FROM lineitem GROUP BY 1",
    "replica_entries": f"WITH {KV_LOG} SELECT seq % 3 AS replica, count(*) AS entries, max(seq) AS applied_seq FROM kv_log WHERE seq >= 300 GROUP BY 1",
    "peer_alive": ALIVE,
    "elect_min_alive": f"SELECT min(node) AS leader FROM ({ALIVE}) WHERE alive",
    "gcounter_merge": f"WITH {COUNTERS} SELECT sum(m)::BIGINT AS value, count(*) AS nodes FROM (SELECT node, max(inc) AS m FROM c GROUP BY 1)",
    "pncounter_merge": f"WITH {COUNTERS} SELECT (sum(p) - sum(m))::BIGINT AS value FROM (SELECT node, max(inc) AS p, max(dec) AS m FROM c GROUP BY 1)",
    "vector_clock_merge": f"WITH {COUNTERS} SELECT node, max(inc) AS clock FROM c GROUP BY 1",
    "counter_ops": "SELECT user_id % 5 AS node, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END)::BIGINT AS counter, count(*) AS clock FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1",
    "phi_accrual": f"""WITH g AS (SELECT user_id AS node, {T} AS t, {T} - lag({T}) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
w AS (SELECT node, t, avg(gap) OVER k AS m, greatest(stddev_pop(gap) OVER k, 0.5) AS d, count(gap) OVER k AS n, row_number() OVER (PARTITION BY node ORDER BY t DESC) AS r FROM g WINDOW k AS (PARTITION BY node ORDER BY t ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
y AS (SELECT *, (SELECT max({T}) FROM events) - t AS s FROM w WHERE r = 1), e AS (SELECT *, exp(-((s - m) / d) * (1.5976 + 0.070566 * ((s - m) / d) * ((s - m) / d))) AS e FROM y)
SELECT node, CASE WHEN n >= 2 THEN round(-log10(greatest(CASE WHEN s > m THEN e / (1 + e) ELSE 1 - 1 / (1 + e) END, 1e-300)), 3) END AS phi FROM e""",
    "gossip_status": f"WITH {SEEN} SELECT node, CASE WHEN now - last > 15000 THEN 'failed' WHEN now - last > 5000 THEN 'suspected' ELSE 'alive' END AS status FROM s",
    "gossip_counters": "WITH e AS (SELECT user_id % 5 AS node, event_id AS inc, epoch_us(ts) AS moment FROM events), b AS (SELECT node, max(inc) AS counter FROM e GROUP BY 1) SELECT b.node, counter, min(moment) AS rose_at FROM b JOIN e ON e.node = b.node AND e.inc = b.counter GROUP BY ALL",
    "split_brain": "WITH s AS (SELECT o_orderpriority AS network, o_orderstatus AS side, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1, 2), w AS (SELECT o_orderpriority AS network, count(DISTINCT o_custkey) AS nodes FROM orders GROUP BY 1) SELECT network, count(*) FILTER (2 * n > nodes) AS with_quorum, count(*) FILTER (2 * n > nodes) > 1 AS split FROM s JOIN w USING (network) GROUP BY network",
    "partition_pairs": "SELECT least(a.n_nationkey, b.n_nationkey) AS low, greatest(a.n_nationkey, b.n_nationkey) AS high FROM nation a, nation b WHERE a.n_regionkey = 0 AND b.n_regionkey = 1",
    "latency_stats": """WITH e AS (SELECT hour(ts)::INT AS hour, event_type, value, row_number() OVER (PARTITION BY hour(ts) ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY hour(ts)) AS n FROM events)
SELECT hour, count(*) AS total, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type <> 'error') / count(*) AS rate, sum(value::DECIMAL(18,2))::DOUBLE / count(*) AS mean,
max(value) FILTER (r = floor(n * 0.5)) AS p50, max(value) FILTER (r = floor(n * 0.95)) AS p95, max(value) FILTER (r = floor(n * 0.99)) AS p99 FROM e GROUP BY hour""",
    "slow_tasks": "SELECT event_id, value FROM events WHERE event_type = 'error' AND value > 1.5 * (SELECT sum(value::DECIMAL(18,2))::DOUBLE / count(*) FROM events WHERE event_type <> 'error')",
    "task_status": "SELECT event_type AS state, event_id % 3 AS attempt, count(*) AS tasks FROM events GROUP BY 1, 2",
    "raft_votes": f"WITH {KV_LOG}, l AS (SELECT seq % 5 AS node, max(segment_id) AS t, count(*) AS i FROM kv_log GROUP BY 1) SELECT c.node AS candidate, v.node AS voter, (c.t > v.t OR (c.t = v.t AND c.i >= v.i)) AS granted FROM l c, l v WHERE c.node <> v.node",
    "raft_append": "SELECT event_id AS idx, event_id // 100 AS term FROM events WHERE 5 * event_id <= 3 * (SELECT max(event_id) FROM events)",
    "raft_commit_index": "WITH m AS (SELECT event_id % 4 AS f, max(event_id) AS x FROM events WHERE event_id % 10 >= event_id % 4 GROUP BY 1) SELECT max(event_id) AS commit_index FROM events WHERE event_id // 100 = (SELECT max(event_id // 100) FROM events) AND event_id <= (SELECT min(x) FROM (SELECT x FROM m ORDER BY x DESC LIMIT 2))",
    "raft_apply": f"WITH {KV_LOG} SELECT key, value, seq, deleted FROM kv_log WHERE seq > 6 * (SELECT max(seq) FROM kv_log) // 10 AND 10 * seq <= 9 * (SELECT max(seq) FROM kv_log) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1",
    "snapshot_due": "SELECT max(event_id) AS last_index, max(event_id) - 500 > 1000 AS due FROM events",
    "session_guarantees": f"WITH {KV_LOG}, l AS (SELECT key, seq, seq * 7919 % 1000 AS r FROM kv_log), m AS (SELECT *, max(r) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM l) SELECT key, count(*) FILTER (r < s) AS stale, count(*) AS reads FROM m GROUP BY key",
}
