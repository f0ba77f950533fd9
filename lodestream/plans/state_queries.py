"""Transactions and state machines over the event log."""

from pyspark.sql import functions as F

from lodestream.operators import folds as fo
from lodestream.operators import mvcc as mv
from lodestream.plans.views import COMMANDS, KV_LOG, VERSIONS, commands, kv_log, versions
from lodestream.tables import table

#: 2024-01-15 00:00 UTC in microseconds: the time of snapshots.
T0 = 1_705_276_800_000_000
DAY = 86_400_000_000


def mvcc_asof_read(spark, sf_dir):
    """What every transaction sees of its key when it starts."""
    v = versions(spark, sf_dir)
    reads = v.select("key", F.col("start_ts").alias("read_ts"), F.col("txn_id").alias("reader"))
    seen = mv.as_of(reads, mv.committed(v), ["value", "txn_id", "deleted"], DAY)
    return seen.select("reader", "key", F.when(~F.col("deleted"), F.col("value")).alias("value"), F.col("txn_id").alias("version"))


def mvcc_snapshot(spark, sf_dir):
    return mv.snapshot(versions(spark, sf_dir), T0)


def mvcc_read_committed(spark, sf_dir):
    """Reads of the same keys at two times: what had committed by each."""
    v = versions(spark, sf_dir)
    one, two = (mv.snapshot(v, t).select("key", F.col("value").alias(n)) for t, n in ((T0, "first"), (T0 + DAY, "second")))
    return one.join(two, "key", "full")


def mvcc_read_uncommitted(spark, sf_dir):
    return mv.uncommitted(versions(spark, sf_dir), T0)


def mvcc_isolation(spark, sf_dir):
    """Keys and values that each isolation level shows to the same transaction a day after it began."""
    v = versions(spark, sf_dir)
    seen = None
    for level in mv.ISOLATION:
        here = mv.read(v, level, T0, T0 + DAY).agg(F.count(F.lit(1)).alias("keys"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")).withColumn("isolation", F.lit(level))
        seen = here if seen is None else seen.unionByName(here)
    return seen


def mvcc_own_writes(spark, sf_dir):
    """Pending writes of one transaction (keys up to 20, those divisible by 7 deleted) over its snapshot."""
    pending = spark.range(0, 21).select(F.col("id").alias("key"), F.lit(-1.0).alias("value"), (F.col("id") % 7 == 0).alias("deleted"))
    return mv.own_or_visible(pending, mv.snapshot(versions(spark, sf_dir), T0))


def mvcc_aborted(spark, sf_dir):
    """Versions by key that commits left, without those of aborted transactions."""
    v = versions(spark, sf_dir)
    gone = v.where("aborted").select("txn_id")
    return v.join(gone, "txn_id", "left_anti").groupBy("key").agg(F.count(F.lit(1)).alias("versions"), F.max("txn_id").alias("last_txn"))


def _gc(safe):
    def query(spark, sf_dir):
        left = mv.collect_garbage(mv.committed(versions(spark, sf_dir)), T0, safe)
        return left.groupBy("key").agg(F.count(F.lit(1)).alias("versions"), F.min("txn_id").alias("oldest"))

    query.__doc__ = "Versions left by the collector" + (", with those visible at its time." if safe else ".")
    return query


def mvcc_write_conflicts(spark, sf_dir):
    """Transactions that begin while others hold their key."""
    return mv.open_before(versions(spark, sf_dir).where("start_ts < commit_ts"), DAY).where("conflicts > 0")


def _reads(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("txn_id"), F.get_json_object("props", "$.k").cast("long").alias("read_key"))
    return versions(spark, sf_dir).join(e, "txn_id").select(F.col("read_key").alias("key"), "txn_id", "start_ts", "commit_ts")


def ssi_rw_edges(spark, sf_dir):
    """Read-write dependencies between overlapping transactions."""
    return mv.rw_edges(_reads(spark, sf_dir), versions(spark, sf_dir).select("key", "txn_id", "start_ts", "commit_ts"), 600_000_000)


def ssi_dangerous(spark, sf_dir):
    return mv.dangerous(ssi_rw_edges(spark, sf_dir))


def twopc_outcome(spark, sf_dir):
    """Orders whose lines were not returned commit."""
    votes = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_returnflag") != "R").alias("ok"))
    return mv.two_phase_outcome(votes, "l_orderkey")


def _fold(step, schema):
    def query(spark, sf_dir):
        return fo.ordered_fold(commands(spark, sf_dir), "key", "idx", step, schema)

    query.__doc__ = step.__doc__
    return query


def sm_kv(spark, sf_dir):
    """Final state of set and delete commands: the last one of each key."""
    last = commands(spark, sf_dir).where("op in ('click', 'view')").groupBy("key").agg(F.max_by(F.struct("op", "owner"), "idx").alias("v"))
    return last.where("v.op = 'click'").select("key", F.col("v.owner").alias("value"))


def sm_kv_snapshot(spark, sf_dir):
    """The same as of the middle of the commands, and how far it had been applied."""
    every = commands(spark, sf_dir)
    part = every.crossJoin(every.agg(F.max("idx").alias("top"))).where("2 * idx <= top")  # one row
    last = part.where("op in ('click', 'view')").groupBy("key").agg(F.max_by(F.struct("op", "owner"), "idx").alias("v"), F.max("idx").alias("applied"))
    return last.where("v.op = 'click'").select("key", F.col("v.owner").alias("value"), "applied")


def sm_config_version(spark, sf_dir):
    """The version of each key's configuration after its commands: set, delete and batch count, get and list do not."""
    return commands(spark, sf_dir).groupBy("key").agg(F.count_if(F.col("op").isin("click", "view", "purchase")).alias("version"))


def sm_config_prefix(spark, sf_dir):
    """list(prefix): live keys that begin with key_01."""
    from lodestream.operators.changelog import live

    return live(kv_log(spark, sf_dir).where(F.startswith("key", F.lit("key_01")))).select("key", "value")


def sm_config_batch(spark, sf_dir):
    """Batches of operations: applied in order, one version for each batch."""
    batches = commands(spark, sf_dir).select(F.floor(F.col("idx") / 50).alias("batch"), F.col("idx").alias("pos"), "key", "op", "owner").where("op in ('click', 'view')")
    last = batches.groupBy("key").agg(F.max_by(F.struct("op", "owner"), F.struct("batch", "pos")).alias("v"), F.count_distinct("batch").alias("versions"))
    return last.select("key", F.when(F.col("v.op") == "click", F.col("v.owner")).alias("value"), "versions")


def retry_delays(spark, sf_dir):
    """min(base * 2^attempt, most) of twelve attempts."""
    return spark.range(12).select(F.col("id").alias("attempt"), F.least(F.lit(0.1) * F.pow(F.lit(2.0), F.col("id")), F.lit(30.0)).alias("delay"))


QUERIES = {f.__name__: f for f in (mvcc_asof_read, mvcc_snapshot, mvcc_read_committed, mvcc_read_uncommitted, mvcc_isolation, mvcc_own_writes, mvcc_aborted, mvcc_write_conflicts, ssi_rw_edges, ssi_dangerous, twopc_outcome, sm_kv, sm_kv_snapshot, sm_config_version, sm_config_prefix, sm_config_batch, retry_delays)}
QUERIES |= {
    "mvcc_gc": _gc(False), "mvcc_gc_safe": _gc(True),
    "sm_lock": _fold(fo.lock_step, "ok boolean, holder long"), "sm_kv_cas": _fold(fo.cas_step, "ok boolean, value long"), "sm_election": _fold(fo.election_step, "ok boolean, leader long, term long"),
    "circuit_breaker": _fold(fo.breaker_step, "allowed boolean, mode int"), "rate_limiter": _fold(fo.limiter_step, "allowed boolean, before int"), "lsm_runs": _fold(fo.memtable_step, "run int"), "ewma_rtt": _fold(fo.ewma_step, "estimate double, deviation double, timeout double"),
}

SEEN = "SELECT *, row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC, txn_id DESC) AS r FROM versions WHERE NOT aborted AND commit_ts <= {}"
SNAPSHOT = "SELECT key, value, txn_id FROM (" + SEEN + ") WHERE r = 1 AND NOT deleted"
EDGES = "e AS (SELECT DISTINCT r.txn_id AS reader, w.txn_id AS writer FROM (SELECT v.*, (props->>'$.k')::BIGINT AS rk FROM versions v JOIN events ON event_id = txn_id) r JOIN versions w ON r.rk = w.key AND r.txn_id <> w.txn_id AND r.start_ts < w.commit_ts AND w.start_ts < r.commit_ts)"


def _machine(init: str, columns: str, body: str, result: str) -> str:
    """A fold as recursion over the row numbers of each key."""
    return f"""WITH RECURSIVE {COMMANDS}, c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx) AS n FROM commands),
f AS (SELECT key, 0::BIGINT AS n, -1::BIGINT AS idx, {init}
UNION ALL SELECT c.key, c.n, c.idx, {body} FROM f JOIN c ON c.key = f.key AND c.n = f.n + 1)
SELECT key, idx, {result} FROM f WHERE n > 0""".replace("SELECT key, 0::BIGINT", "SELECT DISTINCT key, 0::BIGINT").replace(f"-1::BIGINT AS idx, {init}", f"-1::BIGINT AS idx, {init} FROM c")


ALLOWED = "NOT (f.mode = 1 AND c.t - f.opened < 3600)"
MODE = "CASE WHEN f.mode = 1 AND c.t - f.opened >= 3600 THEN 2 ELSE f.mode END"
GC = f"g AS (SELECT *, max(commit_ts) OVER (PARTITION BY key) AS l, max(commit_ts) FILTER (commit_ts < {T0}) OVER (PARTITION BY key) AS o FROM versions WHERE NOT aborted)"
ORACLES = {
    "mvcc_asof_read": f"WITH {VERSIONS} SELECT r.txn_id AS reader, r.key, CASE WHEN NOT v.deleted THEN v.value END AS value, v.txn_id AS version FROM versions r ASOF LEFT JOIN (FROM versions WHERE NOT aborted) v ON r.key = v.key AND r.start_ts >= v.commit_ts",
    "mvcc_snapshot": f"WITH {VERSIONS} {SNAPSHOT.format(T0)}",
    "mvcc_read_committed": f"WITH {VERSIONS} SELECT key, a.value AS first, b.value AS second FROM ({SNAPSHOT.format(T0)}) a FULL JOIN ({SNAPSHOT.format(T0 + DAY)}) b USING (key)",
    "mvcc_read_uncommitted": f"WITH {VERSIONS} SELECT key, value, txn_id FROM versions WHERE start_ts <= {T0} QUALIFY row_number() OVER (PARTITION BY key ORDER BY start_ts DESC, txn_id DESC) = 1",
    "mvcc_isolation": f"""WITH {VERSIONS}, u AS (SELECT value FROM versions WHERE start_ts <= {T0 + DAY} QUALIFY row_number() OVER (PARTITION BY key ORDER BY start_ts DESC, txn_id DESC) = 1)
SELECT 'read_uncommitted' AS isolation, count(*) AS keys, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM u
UNION ALL SELECT 'read_committed', count(*), sum(value::DECIMAL(18,2))::DOUBLE FROM ({SNAPSHOT.format(T0 + DAY)})
UNION ALL SELECT l, count(*), sum(value::DECIMAL(18,2))::DOUBLE FROM ({SNAPSHOT.format(T0)}), (SELECT unnest(['repeatable_read', 'snapshot', 'serializable']) AS l) GROUP BY l""",
    "mvcc_own_writes": f"WITH {VERSIONS} SELECT key, value FROM ({SNAPSHOT.format(T0)}) WHERE key > 20 UNION ALL SELECT range AS key, -1.0::DOUBLE AS value FROM range(21) WHERE range % 7 <> 0",
    "mvcc_aborted": f"WITH {VERSIONS} SELECT key, count(*) AS versions, max(txn_id) AS last_txn FROM versions WHERE NOT aborted GROUP BY key",
    "mvcc_gc": f"WITH {VERSIONS}, {GC} SELECT key, count(*) AS versions, min(txn_id) AS oldest FROM g WHERE commit_ts >= {T0} OR (l < {T0} AND commit_ts = l) GROUP BY key",
    "mvcc_gc_safe": f"WITH {VERSIONS}, {GC} SELECT key, count(*) AS versions, min(txn_id) AS oldest FROM g WHERE commit_ts >= {T0} OR commit_ts = o OR (l < {T0} AND commit_ts = l) GROUP BY key",
    "mvcc_write_conflicts": f"WITH {VERSIONS}, v AS (FROM versions WHERE start_ts < commit_ts) SELECT a.key, a.txn_id, count(*) AS conflicts FROM v a JOIN v b ON a.key = b.key AND a.txn_id <> b.txn_id AND (b.start_ts < a.start_ts OR (b.start_ts = a.start_ts AND b.txn_id < a.txn_id)) AND b.commit_ts > a.start_ts GROUP BY ALL",
    "ssi_rw_edges": f"WITH {VERSIONS}, {EDGES} SELECT * FROM e",
    "ssi_dangerous": f"WITH {VERSIONS}, {EDGES} SELECT o.reader AS txn_id, o.n AS out_conflicts, i.n AS in_conflicts FROM (SELECT reader, count(*) AS n FROM e GROUP BY 1) o JOIN (SELECT writer, count(*) AS n FROM e GROUP BY 1) i ON o.reader = i.writer",
    "twopc_outcome": "SELECT l_orderkey, CASE WHEN bool_and(l_returnflag <> 'R') THEN 'committed' ELSE 'aborted' END AS outcome, count(*) AS participants FROM lineitem GROUP BY 1",
    "sm_kv": f"WITH {COMMANDS} SELECT key, owner AS value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx DESC) AS r FROM commands WHERE op IN ('click', 'view')) WHERE r = 1 AND op = 'click'",
    "sm_kv_snapshot": f"WITH {COMMANDS} SELECT key, owner AS value, idx AS applied FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx DESC) AS r FROM commands WHERE op IN ('click', 'view') AND 2 * idx <= (SELECT max(idx) FROM commands)) WHERE r = 1 AND op = 'click'",
    "sm_config_version": f"WITH {COMMANDS} SELECT key, count(*) FILTER (op IN ('click', 'view', 'purchase')) AS version FROM commands GROUP BY key",
    "sm_config_prefix": f"WITH {KV_LOG} SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM kv_log) WHERE r = 1 AND NOT deleted AND starts_with(key, 'key_01')",
    "sm_config_batch": f"WITH {COMMANDS}, b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx DESC) AS r FROM commands WHERE op IN ('click', 'view')) SELECT key, max(CASE WHEN r = 1 AND op = 'click' THEN owner END) AS value, count(DISTINCT idx // 50) AS versions FROM b GROUP BY key",
    "retry_delays": "SELECT range AS attempt, least(0.1::DOUBLE * pow(2.0::DOUBLE, range), 30.0::DOUBLE) AS delay FROM range(12)",
    "sm_lock": _machine("-1::BIGINT AS holder, false AS ok", "holder, ok", "CASE WHEN c.op = 'click' AND f.holder IN (-1, c.owner) THEN c.owner WHEN c.op = 'view' AND f.holder = c.owner THEN -1 ELSE f.holder END, CASE c.op WHEN 'click' THEN f.holder IN (-1, c.owner) WHEN 'view' THEN f.holder = c.owner ELSE f.holder <> -1 END", "ok, holder"),
    "sm_kv_cas": _machine("NULL::BIGINT AS v, false AS ok", "v, ok", "CASE WHEN c.op = 'click' THEN c.owner WHEN c.op = 'view' THEN NULL WHEN c.op = 'purchase' AND f.v IS NOT DISTINCT FROM CASE WHEN c.owner % 3 = 0 THEN NULL ELSE c.owner END THEN c.value ELSE f.v END, CASE c.op WHEN 'click' THEN true WHEN 'purchase' THEN f.v IS NOT DISTINCT FROM CASE WHEN c.owner % 3 = 0 THEN NULL ELSE c.owner END ELSE f.v IS NOT NULL END", "ok, coalesce(v, -1) AS value"),
    "sm_election": _machine("-1::BIGINT AS leader, 0::BIGINT AS term, false AS ok", "leader, term, ok", "CASE WHEN c.op = 'click' AND f.leader = -1 THEN c.owner WHEN c.op = 'view' AND f.leader = c.owner THEN -1 ELSE f.leader END, CASE WHEN c.op = 'click' AND f.leader = -1 THEN f.term + 1 ELSE f.term END, CASE WHEN c.op = 'click' THEN f.leader = -1 WHEN c.op IN ('view', 'purchase') THEN f.leader = c.owner ELSE f.leader <> -1 END", "ok, leader, term"),
    "circuit_breaker": _machine(
        "0 AS mode, 0 AS failures, 0::BIGINT AS opened, 0 AS successes, false AS allowed", "",
        f"""CASE WHEN NOT ({ALLOWED}) THEN f.mode WHEN c.op = 'error' AND (({MODE}) = 2 OR f.failures + 1 >= 2) THEN 1 WHEN c.op <> 'error' AND ({MODE}) = 2 AND (CASE WHEN f.mode = 1 THEN 0 ELSE f.successes END) + 1 >= 2 THEN 0 ELSE ({MODE}) END,
CASE WHEN NOT ({ALLOWED}) THEN f.failures WHEN c.op = 'error' THEN f.failures + 1 WHEN ({MODE}) = 2 THEN CASE WHEN (CASE WHEN f.mode = 1 THEN 0 ELSE f.successes END) + 1 >= 2 THEN 0 ELSE f.failures END ELSE 0 END,
CASE WHEN ({ALLOWED}) AND c.op = 'error' AND (({MODE}) = 2 OR f.failures + 1 >= 2) THEN c.t ELSE f.opened END,
CASE WHEN NOT ({ALLOWED}) THEN f.successes ELSE (CASE WHEN f.mode = 1 THEN 0 ELSE f.successes END) + CASE WHEN c.op <> 'error' AND ({MODE}) = 2 THEN 1 ELSE 0 END END, {ALLOWED}""", "allowed, mode"),
    "rate_limiter": _machine("[]::BIGINT[] AS passed, false AS allowed, 0 AS before", "", "CASE WHEN len(list_filter(f.passed, lambda x: x > c.t - 7200)) < 3 THEN list_append(list_filter(f.passed, lambda x: x > c.t - 7200), c.t) ELSE list_filter(f.passed, lambda x: x > c.t - 7200) END, len(list_filter(f.passed, lambda x: x > c.t - 7200)) < 3, len(list_filter(f.passed, lambda x: x > c.t - 7200))::INT", "allowed, before"),
    "lsm_runs": _machine("[]::BIGINT[] AS m, 0 AS run", "", "CASE WHEN list_contains(f.m, c.owner) THEN f.m WHEN len(f.m) = 5 THEN [c.owner] ELSE list_append(f.m, c.owner) END, CASE WHEN NOT list_contains(f.m, c.owner) AND len(f.m) = 5 THEN f.run + 1 ELSE f.run END", "run"),
    "ewma_rtt": _machine("NULL::DOUBLE AS e, NULL::DOUBLE AS d", "", "CASE WHEN f.e IS NULL THEN c.value::DOUBLE ELSE (1 - 0.1::DOUBLE) * f.e + 0.1::DOUBLE * c.value END, CASE WHEN f.e IS NULL THEN c.value / 2.0::DOUBLE ELSE (1 - 0.1::DOUBLE) * f.d + 0.1::DOUBLE * abs(c.value - f.e) END", "e AS estimate, d AS deviation, e + 4 * d AS timeout"),
}
