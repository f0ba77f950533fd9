"""Routing and rebalancing of the order keys."""

from pyspark.sql import functions as F

from lodestream.operators import routing as r
from lodestream.operators.mapreduce import partition_of
from lodestream.plans.mapreduce_queries import sql_md5_mod
from lodestream.plans.views import SHARD_ROWS, shard_rows

NODES = ["shard_0", "shard_1", "shard_2"]
CUTS = [(None, "3", "low"), ("3", "6", "middle"), ("6", "9", "high")]
SKEWED = [(None, "15", "a"), ("15", "2", "b"), ("2", "5", "c"), ("5", None, "d")]


def route_md5_mod(spark, sf_dir):
    return shard_rows(spark, sf_dir).select("key", partition_of(F.col("key"), 16).alias("part"))


def route_ring_owner(spark, sf_dir):
    return r.owners(shard_rows(spark, sf_dir).select("key"), NODES)


def route_ring_replicas(spark, sf_dir):
    return r.replicas(shard_rows(spark, sf_dir).select("key"), NODES, 2)


def route_range(spark, sf_dir):
    return r.ranges(shard_rows(spark, sf_dir).select("key"), CUTS)


def route_range_scan(spark, sf_dir):
    """A half-open key range; ranges that do not touch it are never read."""
    rows = r.ranges(shard_rows(spark, sf_dir), CUTS)
    return rows.where("key >= '25' and key < '31'").select("key", "owner", "value")


def shard_distribution(spark, sf_dir):
    nodes = [*NODES, "shard_9"]
    return r.distribution(r.owners(shard_rows(spark, sf_dir).select("key"), NODES), nodes)


def rebalance_add_moves(spark, sf_dir):
    """Keys that a new node takes over."""
    return r.moved(shard_rows(spark, sf_dir).select("key"), NODES, [*NODES, "shard_3"])


def rebalance_remove_moves(spark, sf_dir):
    """Keys that a leaving node hands on."""
    return r.moved(shard_rows(spark, sf_dir).select("key"), NODES, NODES[:2])


def rebalance_overload(spark, sf_dir):
    owned = r.ranges(shard_rows(spark, sf_dir).select("key"), SKEWED)
    return r.load_classes(r.distribution(owned, [c[2] for c in SKEWED])).select("owner", "n", F.round("excess", 4).alias("excess"), "class")


def rebalance_moves(spark, sf_dir):
    """How many keys the plan moves from each node to each."""
    owned = r.ranges(shard_rows(spark, sf_dir).select("key"), SKEWED)
    plan = r.rebalance_plan(owned, r.distribution(owned, [c[2] for c in SKEWED]))
    return plan.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"))


def split_point(spark, sf_dir):
    return r.split_point(r.ranges(shard_rows(spark, sf_dir).select("key"), SKEWED), "b")


def merge_shards(spark, sf_dir):
    """Two shards into one; the second holds newer values for keys divisible by 10."""
    rows = shard_rows(spark, sf_dir)
    source = rows.where("cast(key as long) % 10 = 0").withColumn("value", F.lit(-1.0))
    return r.merge_shards(rows.where("cast(key as long) % 2 = 0"), source)


def multi_get(spark, sf_dir):
    """Routed reads: owner and value of every 100th key."""
    rows = shard_rows(spark, sf_dir)
    wanted = spark.range(0, 10_000_000, 100).select(F.col("id").cast("string").alias("key"))
    return r.owners(rows.join(wanted, "key", "left_semi"), NODES)


QUERIES = {f.__name__: f for f in (route_md5_mod, route_ring_owner, route_ring_replicas, route_range, route_range_scan, shard_distribution, rebalance_add_moves, rebalance_remove_moves, rebalance_overload, rebalance_moves, split_point, merge_shards, multi_get)}


def _ring(nodes: list[str], name: str) -> str:
    listed = ", ".join(f"'{n}'" for n in nodes)
    return f"""{name}_v AS (SELECT md5(n || ':' || i) AS p, n FROM (SELECT unnest([{listed}]) AS n), range(150) t(i)),
{name} AS (SELECT p, n FROM {name}_v UNION ALL SELECT 'g' AS p, (SELECT n FROM {name}_v ORDER BY p LIMIT 1) AS n)"""


def _owner(ring: str, key: str, out: str) -> str:
    return f"(SELECT n FROM {ring} WHERE p > md5({key}) ORDER BY p LIMIT 1) AS {out}"


def _asof(ring: str, source: str = "shard_rows") -> str:
    """Owner by the first position after the hash."""
    return f"SELECT s.key, r.n AS owner FROM (SELECT key, md5(key) AS h FROM {source}) s ASOF JOIN {ring} r ON s.h < r.p"


RANGED = "CASE WHEN key < '3' THEN 'low' WHEN key < '6' THEN 'middle' WHEN key < '9' THEN 'high' END"
SKEWED_SQL = "CASE WHEN key < '15' THEN 'a' WHEN key < '2' THEN 'b' WHEN key < '5' THEN 'c' ELSE 'd' END"
SIZES = f"sizes AS (SELECT o.owner, count(key) AS n FROM (SELECT unnest(['a','b','c','d']) AS owner) o LEFT JOIN (SELECT key, {SKEWED_SQL} AS owner FROM shard_rows) k USING (owner) GROUP BY 1), classes AS (SELECT owner, n, n - avg(n) OVER () AS excess, CASE WHEN n > avg(n) OVER () * 1.2 THEN 'over' WHEN n < avg(n) OVER () * 0.8 THEN 'under' ELSE 'even' END AS class FROM sizes)"
MOVED = "SELECT a.key, a.owner AS source, b.owner AS target FROM ({}) a JOIN ({}) b USING (key) WHERE a.owner <> b.owner"
ORACLES = {
    "route_md5_mod": f"WITH {SHARD_ROWS} SELECT key, {sql_md5_mod('key', 16)} AS part FROM shard_rows",
    "route_ring_owner": f"WITH {SHARD_ROWS}, {_ring(NODES, 'r')} {_asof('r')}",
    "route_ring_replicas": f"""WITH {SHARD_ROWS}, {_ring(NODES, 'r')}, f AS (SELECT s.key, r.p, r.n FROM (SELECT key, md5(key) AS h FROM shard_rows) s ASOF JOIN r ON s.h < r.p),
v AS (SELECT p, n, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS c FROM r_v),
nx AS (SELECT a.p, a.n, (SELECT b.n FROM v b WHERE b.n <> a.n ORDER BY (b.k - a.k + b.c) % b.c LIMIT 1) AS m FROM v a)
SELECT key, unnest([0, 1])::INT AS place, unnest([f.n, coalesce(nx.m, w.m)]) AS node FROM f LEFT JOIN nx ON f.p = nx.p, (SELECT m FROM nx ORDER BY p LIMIT 1) w""",
    "route_range": f"WITH {SHARD_ROWS} SELECT key, {RANGED} AS owner FROM shard_rows",
    "route_range_scan": f"WITH {SHARD_ROWS} SELECT key, {RANGED} AS owner, value FROM shard_rows WHERE key >= '25' AND key < '31'",
    "shard_distribution": f"WITH {SHARD_ROWS}, {_ring(NODES, 'r')}, o AS ({_asof('r')}) SELECT n.owner, count(o.key) AS n FROM (SELECT unnest(['shard_0', 'shard_1', 'shard_2', 'shard_9']) AS owner) n LEFT JOIN o USING (owner) GROUP BY 1",
    "rebalance_add_moves": f"WITH {SHARD_ROWS}, {_ring(NODES, 'r')}, {_ring([*NODES, 'shard_3'], 's')} " + MOVED.format(_asof("r"), _asof("s")),
    "rebalance_remove_moves": f"WITH {SHARD_ROWS}, {_ring(NODES, 'r')}, {_ring(NODES[:2], 's')} " + MOVED.format(_asof("r"), _asof("s")),
    "rebalance_overload": f"WITH {SHARD_ROWS}, {SIZES} SELECT owner, n, round(excess, 4) AS excess, class FROM classes",
    "rebalance_moves": f"""WITH {SHARD_ROWS}, {SIZES}, g AS (SELECT owner, floor(excess)::BIGINT AS a, sum(floor(excess)::BIGINT) OVER (ORDER BY owner) AS e FROM classes WHERE class = 'over'),
t AS (SELECT owner, sum(floor(-excess)::BIGINT) OVER (ORDER BY owner) - floor(-excess)::BIGINT AS b, sum(floor(-excess)::BIGINT) OVER (ORDER BY owner) AS e FROM classes WHERE class = 'under'),
k AS (SELECT key, owner, row_number() OVER (PARTITION BY owner ORDER BY key) - 1 AS i FROM (SELECT key, {SKEWED_SQL} AS owner FROM shard_rows))
SELECT k.owner AS source, t.owner AS target, count(*) AS n, min(key) AS first_key FROM k JOIN g ON k.owner = g.owner AND i < a JOIN t ON e_at(i, g.e, g.a) >= t.b AND e_at(i, g.e, g.a) < t.e GROUP BY ALL""".replace("e_at(i, g.e, g.a)", "(g.e - g.a + i)"),
    "split_point": f"WITH {SHARD_ROWS}, m AS (SELECT key, row_number() OVER (ORDER BY key) AS p, count(*) OVER () AS c FROM (SELECT key, {SKEWED_SQL} AS owner FROM shard_rows) WHERE owner = 'b') SELECT key AS split_at, c - p + 1 AS moving FROM m WHERE p = c // 2 + 1",
    "merge_shards": f"WITH {SHARD_ROWS} SELECT key, CASE WHEN key::BIGINT % 10 = 0 THEN -1.0 ELSE value END AS value FROM shard_rows WHERE key::BIGINT % 2 = 0",
    "multi_get": f"WITH {SHARD_ROWS}, {_ring(NODES, 'r')}, o AS ({_asof('r')}) SELECT key, value, owner FROM shard_rows JOIN o USING (key) WHERE key::BIGINT % 100 = 0",
}
