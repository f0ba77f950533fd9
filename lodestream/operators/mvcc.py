"""Multi-version reads and conflict detection over a table of versions (key, value, txn_id, start_ts, commit_ts, ...).

As-of reads and overlaps are swept in time order within buckets of time, so a key with very many versions is spread over
its buckets and nothing is compared pair by pair."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def committed(versions: DataFrame) -> DataFrame:
    return versions.where("not aborted")


def as_of(reads: DataFrame, versions: DataFrame, columns: list[str], width: int) -> DataFrame:
    """``reads`` (key, read_ts, ...) with the columns of the last version that had committed by read_ts.

    Each bucket of ``width`` starts with the last version of the buckets before it; within a bucket, the last version
    seen so far goes to every read."""
    v = versions.select("key", F.col("commit_ts").alias("_t"), F.struct(*columns).alias("_v"), F.col("txn_id").alias("_o")).withColumn("_b", F.floor(F.col("_t") / width))
    r = reads.withColumns({"_t": F.col("read_ts"), "_b": F.floor(F.col("read_ts") / width)})
    last = v.groupBy("key", "_b").agg(F.max_by("_v", F.struct("_t", "_o")).alias("_v")).withColumn("_has", F.lit(True))
    buckets = last.unionByName(r.select("key", "_b").distinct(), allowMissingColumns=True).groupBy("key", "_b").agg(F.first("_v", ignorenulls=True).alias("_v"))
    before = F.last("_v", ignorenulls=True).over(W.partitionBy("key").orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    carried = buckets.withColumn("_v", before).where("_v is not null").select("key", "_b", (F.col("_b") * width).cast("long").alias("_t"), "_v", F.lit(-1).cast("long").alias("_o"))
    events = v.unionByName(carried).withColumn("_k", F.lit(0)).unionByName(r.withColumn("_k", F.lit(1)), allowMissingColumns=True)
    seen = F.last("_v", ignorenulls=True).over(W.partitionBy("key", "_b").orderBy("_t", "_k", "_o").rowsBetween(W.unboundedPreceding, 0))
    return events.withColumn("_v", seen).where("_k = 1").select(*reads.columns, "_v.*")


def snapshot(versions: DataFrame, ts: int) -> DataFrame:
    """The state at a time: the last committed version of every key, without deleted ones."""
    seen = committed(versions).where(F.col("commit_ts") <= ts)
    return seen.groupBy("key").agg(F.max_by(F.struct("value", "txn_id", "deleted"), F.struct("commit_ts", "txn_id")).alias("v")).where("not v.deleted").select("key", "v.value", "v.txn_id")


def uncommitted(writes: DataFrame, ts: int) -> DataFrame:
    """The newest write of every key that had begun by a time, committed or not."""
    return writes.where(F.col("start_ts") <= ts).groupBy("key").agg(F.max_by(F.struct("value", "txn_id"), F.struct("start_ts", "txn_id")).alias("v")).select("key", "v.*")


def own_or_visible(pending: DataFrame, visible: DataFrame) -> DataFrame:
    """A transaction's own pending writes (key, value, deleted) before what its snapshot shows."""
    own = pending.select("key", "value", "deleted", F.lit(1).alias("p"))
    rows = own.unionByName(visible.select("key", "value", F.lit(False).alias("deleted"), F.lit(0).alias("p")))
    return rows.groupBy("key").agg(F.max_by(F.struct("value", "deleted"), "p").alias("v")).where("not v.deleted").select("key", "v.value")


def collect_garbage(versions: DataFrame, before_ts: int, safe: bool) -> DataFrame:
    """Versions to keep: those from ``before_ts`` on, or a key's last if it has none; ``safe`` also keeps what is visible at that time."""
    newest = versions.groupBy("key").agg(F.max("commit_ts").alias("_last"), F.max(F.when(F.col("commit_ts") < before_ts, F.col("commit_ts"))).alias("_old"))
    keep = (F.col("commit_ts") >= before_ts) | ((F.col("_last") < before_ts) & (F.col("commit_ts") == F.col("_last")))
    if safe:
        keep |= F.col("commit_ts") == F.col("_old")
    return versions.join(newest, "key").where(keep).drop("_last", "_old")


def open_before(intervals: DataFrame, width: int = 86_400_000_000) -> DataFrame:
    """Each transaction with how many others on its key had begun and not ended when it began: begun minus ended so far.
    Counted within buckets of ``width``, on top of what the key's earlier buckets leave open (a row per key and bucket)."""
    begins = intervals.select("key", "txn_id", F.col("start_ts").alias("t"), F.lit(1).alias("d"), F.lit(1).alias("begin"))
    ends = intervals.select("key", "txn_id", F.col("commit_ts").alias("t"), F.lit(-1).alias("d"), F.lit(0).alias("begin"))
    rows = begins.unionByName(ends).withColumn("b", F.floor(F.col("t") / width))
    earlier = W.partitionBy("key").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    carried = rows.groupBy("key", "b").agg(F.sum("d").alias("d")).select("key", "b", F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("open"))
    inside = W.partitionBy("key", "b").orderBy("t", "begin", "txn_id").rowsBetween(W.unboundedPreceding, -1)
    counted = rows.withColumn("here", F.coalesce(F.sum("d").over(inside), F.lit(0))).where("begin = 1")
    return counted.join(carried, ["key", "b"]).select("key", "txn_id", (F.col("here") + F.col("open")).alias("conflicts"))


def rw_edges(reads: DataFrame, writes: DataFrame, width: int) -> DataFrame:
    """(reader, writer): the reader read a key that an overlapping transaction wrote. As many rows as there are such pairs.

    Buckets have levels: those of level k are ``width`` * 2**k long. An interval belongs to the first level whose buckets
    are as long as itself, and is listed in the two buckets at most that it touches there and on every higher level that
    is in use. A pair meets on the higher of its two levels, so a row stands for at most two listings a level however
    long an interval is."""
    level = F.greatest(F.ceil(F.log2(F.greatest(F.col("commit_ts") - F.col("start_ts"), F.lit(1)) / width)), F.lit(0)).cast("int")
    top = reads.select(level.alias("level")).union(writes.select(level.alias("level"))).agg(F.coalesce(F.max("level"), F.lit(0)).alias("top"))  # one row

    def listed(df: DataFrame, p: str) -> DataFrame:
        rows = df.select("key", F.col("txn_id").alias(f"{p}_txn"), F.col("start_ts").alias(f"{p}_s"), F.col("commit_ts").alias(f"{p}_e"), level.alias(f"{p}_level")).crossJoin(top)
        rows = rows.withColumn("level", F.explode(F.sequence(f"{p}_level", "top"))).withColumn("size", F.lit(width) * F.pow(F.lit(2.0), "level").cast("bigint"))
        first, last = F.floor(F.col(f"{p}_s") / F.col("size")), F.floor(F.col(f"{p}_e") / F.col("size"))
        return rows.withColumn("bucket", F.explode(F.sequence(first, last))).drop("top", "size")

    pairs = listed(reads, "r").join(listed(writes, "w"), ["key", "level", "bucket"])
    pairs = pairs.where("level = greatest(r_level, w_level) and r_txn <> w_txn and r_s < w_e and w_s < r_e")
    return pairs.select(F.col("r_txn").alias("reader"), F.col("w_txn").alias("writer")).distinct()


def dangerous(edges: DataFrame) -> DataFrame:
    """Pivot transactions: some other depends on them and they depend on some other."""
    out = edges.groupBy(F.col("reader").alias("txn_id")).agg(F.count(F.lit(1)).alias("out_conflicts"))
    into = edges.groupBy(F.col("writer").alias("txn_id")).agg(F.count(F.lit(1)).alias("in_conflicts"))
    return out.join(into, "txn_id")


def two_phase_outcome(votes: DataFrame, txn: str) -> DataFrame:
    """Commit if all participants voted yes."""
    return votes.groupBy(txn).agg(F.when(F.bool_and("ok"), "committed").otherwise("aborted").alias("outcome"), F.count(F.lit(1)).alias("participants"))


#: Isolation levels: what bounds the versions that a read may see. Serializable reads are snapshot reads whose commits
#: are checked for dangerous structures.
ISOLATION = ("read_uncommitted", "read_committed", "repeatable_read", "snapshot", "serializable")


def read(versions: DataFrame, isolation: str, begun_ts: int, now_ts: int) -> DataFrame:
    """key and value as a transaction that began at ``begun_ts`` reads them at ``now_ts``."""
    if isolation not in ISOLATION:
        raise ValueError(f"unknown isolation level {isolation}")
    if isolation == "read_uncommitted":
        return uncommitted(versions, now_ts).select("key", "value")
    return snapshot(versions, now_ts if isolation == "read_committed" else begun_ts).select("key", "value")
