"""Replication lag, quorums, convergent counters, failure detectors and load statistics, each as one or two aggregations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def lag(leader: DataFrame, followers: DataFrame, names: DataFrame) -> DataFrame:
    """Leader's last number minus each follower's (-1 without entries), also of followers without any."""
    last = followers.groupBy("follower").agg(F.max("seq").alias("seq"))
    top = leader.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("top"))
    return names.join(last, "follower", "left").crossJoin(top).select("follower", (F.col("top") - F.coalesce("seq", F.lit(-1))).alias("lag"))


def quorum(acks: DataFrame, key: str, ok: Column, need: Column) -> DataFrame:
    """Entries with their acknowledgements, the leader's own included, and whether they reach the quorum."""
    return acks.groupBy(key).agg((F.count_if(ok) + 1).alias("acks"), F.count(F.lit(1)).alias("followers")).withColumn("committed", F.col("acks") >= need)


def max_per_node(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The join of grow-only states: per node the greatest of each counter (also a vector clock)."""
    return rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in columns])


def heartbeats(beats: DataFrame, node: str, ts: str, last: int) -> DataFrame:
    """Mean and deviation of the last ``last`` intervals up to each heartbeat (seconds)."""
    order = W.partitionBy(node).orderBy(ts)
    gaps = beats.withColumn("gap", F.col(ts) - F.lag(ts).over(order))
    recent = order.rowsBetween(-(last - 1), 0)
    return gaps.withColumns({"mean": F.avg("gap").over(recent), "dev": F.stddev_pop("gap").over(recent), "n": F.count("gap").over(recent)})


def phi(silence: Column, mean: Column, dev: Column) -> Column:
    """Suspicion: minus the logarithm of the chance that a heartbeat is still to come, with a logistic approximation of the normal distribution."""
    y = (silence - mean) / dev
    e = F.exp(-y * (1.5976 + 0.070566 * y * y))
    later = F.when(silence > mean, e / (1 + e)).otherwise(1 - 1 / (1 + e))
    return -F.log10(F.greatest(later, F.lit(1e-300)))


def age_status(now: Column, last: Column, suspected: float = 5.0, failed: float = 15.0) -> Column:
    return F.when(now - last > failed, "failed").when(now - last > suspected, "suspected").otherwise("alive")


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles by nearest rank: the value at place floor(n * p). Places come from the counts of distinct values,
    so a key with a third of all rows is not sorted in one task row by row."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    key = W.partitionBy(*keys)
    upto = counts.withColumns({"hi": F.sum("c").over(key.orderBy(value).rowsBetween(W.unboundedPreceding, 0)), "n": F.sum("c").over(key)})
    at = {name: F.floor(F.col("n") * p) for name, p in shares.items()}
    picks = [F.max(F.when((at[name] < F.col("hi")) & (at[name] >= F.col("hi") - F.col("c")), F.col(value))).alias(name) for name in shares]
    return upto.groupBy(*keys).agg(*picks)


def append_entries(mine: DataFrame, sent: DataFrame) -> DataFrame:
    """A follower's log after entries (idx, term) arrive: its own up to the first conflict, and all that was sent."""
    conflict = mine.join(sent.withColumnRenamed("term", "sent_term"), "idx").where("term <> sent_term").agg(F.min("idx").alias("first"))
    kept = mine.crossJoin(conflict).where("first is null or idx < first").drop("first")
    return kept.join(sent, "idx", "left_anti").unionByName(sent)


def commit_index(match: DataFrame, entries: DataFrame, members: int) -> DataFrame:
    """The largest entry of the current (the last) term that a majority holds, the leader included."""
    need = members // 2  # followers beside the leader
    best = match.orderBy(F.desc("idx")).limit(need) if need else None
    reached = entries.agg(F.max("idx").alias("reached")) if best is None else best.agg(F.when(F.count(F.lit(1)) == need, F.min("idx")).alias("reached"))
    now = entries.agg(F.max("term").alias("now"))
    return entries.crossJoin(reached).crossJoin(now).where("idx <= reached and term = now").agg(F.max("idx").alias("commit_index"))  # one row each


def sides_with_quorum(members: DataFrame) -> DataFrame:
    """For each partitioned network (network, side, node): how many sides reach more than half of its nodes, and whether
    that is more than one, so that each could go on by itself."""
    sizes = members.groupBy("network", "side").agg(F.countDistinct("node").alias("n"))
    whole = members.groupBy("network").agg(F.countDistinct("node").alias("nodes"))
    strong = F.count_if(2 * F.col("n") > F.col("nodes"))
    return sizes.join(whole, "network").groupBy("network").agg(strong.alias("with_quorum"), (strong > 1).alias("split"))
