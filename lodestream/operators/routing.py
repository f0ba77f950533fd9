"""Where keys live: md5 modulo, a hash ring with virtual nodes, key ranges; and plans to move keys.

A ring is a small table of intervals of md5 hex strings (fixed width, so text order is numeric order). Its size is
nodes times virtual nodes, known before the query runs; lookups join on the interval with the ring broadcast."""

import hashlib
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestream.operators.ordering import numbered

VIRTUAL = 150


def ring(nodes: list[str], virtual: int = VIRTUAL) -> list[tuple[str, str]]:
    """(position, node), sorted."""
    return sorted((hashlib.md5(f"{n}:{i}".encode()).hexdigest(), n) for n in nodes for i in range(virtual))


def ring_intervals(spark: SparkSession, nodes: list[str], virtual: int = VIRTUAL) -> DataFrame:
    """lo, hi, owner: a hash h with lo <= h < hi belongs to the owner; the last interval wraps to the first position.

    A key belongs to the first position strictly after its hash."""
    at = ring(nodes, virtual)
    places = [p for p, _ in at]
    rows = [("", places[0], at[0][1])] + [(a, b, n) for a, (b, n) in zip(places, at[1:], strict=False) if a < b] + [(places[-1], "g", at[0][1])]
    return spark.createDataFrame(rows, "lo string, hi string, owner string")


def owners(keys: DataFrame, nodes: list[str], virtual: int = VIRTUAL, out: str = "owner") -> DataFrame:
    """``keys`` with the node that owns the column key. A coarse bucket (first two hex digits) makes the lookup an
    equality join; an interval is listed in each bucket that it touches."""
    intervals = ring_intervals(keys.sparkSession, nodes, virtual)
    hexes = F.array(*[F.lit(f"{i:02x}") for i in range(256)])
    touched = F.filter(hexes, lambda x: (x >= F.substring("lo", 1, 2)) & (x <= F.substring("hi", 1, 2)))
    table = F.broadcast(intervals.select(F.explode(touched).alias("_b"), "lo", "hi", F.col("owner").alias(out)))
    hashed = keys.withColumn("_h", F.md5(F.col("key").cast("binary"))).withColumn("_b", F.substring("_h", 1, 2))
    joined = hashed.join(table, "_b").where((F.col("_h") >= F.col("lo")) & (F.col("_h") < F.col("hi")))
    return joined.drop("_b", "_h", "lo", "hi")


def replicas(keys: DataFrame, nodes: list[str], count: int, virtual: int = VIRTUAL) -> DataFrame:
    """(key, place, node): the first ``count`` different nodes clockwise. The list of nodes after each position is
    worked out on the ring, not per key."""
    at = ring(nodes, virtual)
    places = [p for p, _ in at]
    rows = []
    for lo, hi in zip(["", *places], [*places, "g"], strict=True):
        k, found = bisect_right(places, lo) if lo else 0, []
        for j in range(len(at)):
            n = at[(k + j) % len(at)][1]
            if n not in found:
                found.append(n)
            if len(found) == count:
                break
        rows.append((lo, hi, found))
    table = keys.sparkSession.createDataFrame(rows, "lo string, hi string, nodes array<string>")
    hexes = F.array(*[F.lit(f"{i:02x}") for i in range(256)])
    touched = F.filter(hexes, lambda x: (x >= F.substring("lo", 1, 2)) & (x <= F.substring("hi", 1, 2)))
    hashed = keys.withColumn("_h", F.md5(F.col("key").cast("binary"))).withColumn("_b", F.substring("_h", 1, 2))
    joined = hashed.join(F.broadcast(table.select(F.explode(touched).alias("_b"), "lo", "hi", "nodes")), "_b").where("_h >= lo and _h < hi")
    return joined.select("key", F.posexplode("nodes").alias("place", "node"))


def ranges(keys: DataFrame, cuts: list[tuple[str | None, str | None, str]], out: str = "owner") -> DataFrame:
    """Owner by half-open key ranges (null: open end); a key outside of all ranges has none."""
    owner = None
    for lo, hi, name in cuts:
        inside = (F.lit(True) if lo is None else F.col("key") >= lo) & (F.lit(True) if hi is None else F.col("key") < hi)
        owner = F.when(inside, name) if owner is None else owner.when(inside, name)
    return keys.withColumn(out, owner if owner is not None else F.lit(None).cast("string"))


def moved(keys: DataFrame, before: list[str], after: list[str], virtual: int = VIRTUAL) -> DataFrame:
    """(key, source, target) of keys whose owner changes with the membership."""
    both = owners(owners(keys, before, virtual, "source"), after, virtual, "target")
    return both.where("source <> target")


def distribution(owned: DataFrame, nodes: list[str], owner: str = "owner") -> DataFrame:
    """Rows of every node, also of those without any."""
    names = owned.sparkSession.createDataFrame([(n,) for n in nodes], f"{owner} string")
    return names.join(owned.groupBy(owner).agg(F.count(F.lit(1)).alias("n")), owner, "left").select(owner, F.coalesce("n", F.lit(0)).alias("n"))


def load_classes(sizes: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """owner, n, excess over the mean and whether the node is over or under it by more than the tolerance. One row per node."""
    mean = sizes.agg(F.avg("n").alias("mean"))
    out = sizes.crossJoin(mean).withColumn("excess", F.col("n") - F.col("mean"))
    return out.withColumn("class", F.when(F.col("n") > F.col("mean") * (1 + tolerance), "over").when(F.col("n") < F.col("mean") * (1 - tolerance), "under").otherwise("even")).drop("mean")


def rebalance_plan(owned: DataFrame, sizes: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """(key, source, target): the excess of overloaded nodes goes to underloaded ones, both lined up end to end; a key
    moves to the node in whose stretch of the line it lies."""
    classes = load_classes(sizes, tolerance)
    give = classes.where("class = 'over'").select(F.col("owner").alias("source"), F.floor("excess").alias("amount"))
    take = classes.where("class = 'under'").select(F.col("owner").alias("target"), F.floor(-F.col("excess")).alias("amount"))

    def line(df: DataFrame, name: str, prefix: str) -> DataFrame:  # a row per node
        end = F.sum("amount").over(W.orderBy(name).rowsBetween(W.unboundedPreceding, 0))
        return df.select(name, (end - F.col("amount")).alias(f"{prefix}_from"), end.alias(f"{prefix}_to"))

    sources, targets = line(give, "source", "s"), line(take, "target", "t")
    rows = numbered(owned, ["owner"], ["key"], "_n")
    placed = rows.join(F.broadcast(sources), F.col("owner") == F.col("source")).where(F.col("_n") < F.col("s_to") - F.col("s_from")).withColumn("_at", F.col("s_from") + F.col("_n"))
    return placed.join(F.broadcast(targets), (F.col("_at") >= F.col("t_from")) & (F.col("_at") < F.col("t_to"))).select("key", "source", "target")


def split_point(owned: DataFrame, owner: str) -> DataFrame:
    """The key in the middle of a node's sorted keys, and how many keys lie at or after it: they would move."""
    mine = owned.where(F.col("owner") == owner).select("key")
    n = F.broadcast(mine.agg(F.count(F.lit(1)).alias("n")))  # one row
    ordered = numbered(mine.withColumn("_all", F.lit(0)), ["_all"], ["key"]).crossJoin(n)
    return ordered.where(F.col("number") == F.floor(F.col("n") / 2)).select(F.col("key").alias("split_at"), (F.col("n") - F.col("number")).alias("moving"))


def merge_shards(target: DataFrame, source: DataFrame) -> DataFrame:
    """Rows of both; on the same key the source's."""
    return target.join(source.select("key"), "key", "left_anti").unionByName(source)
