"""Log-structured key/value state. A store is a changelog (seq, key, value, deleted, ...); its state is an aggregation.

The latest version of a key is ``max_by`` over a struct, which combines partially on the map side, so a key with a
third of all changes leaves each task as one row. No sort or window over a key's history is needed."""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def latest(log: DataFrame, keys: list[str], order: str | Column, columns: list[str]) -> DataFrame:
    """The last version of each key, tombstones included."""
    by = F.col(order) if isinstance(order, str) else order
    return log.groupBy(*keys).agg(F.max_by(F.struct(*columns), by).alias("_v")).select(*keys, "_v.*")


def live(log: DataFrame) -> DataFrame:
    """key, value, seq of all keys that are not deleted."""
    return latest(log, ["key"], "seq", ["value", "seq", "deleted"]).where("not deleted").drop("deleted")


def get(log: DataFrame, key: str) -> DataFrame:
    """The live version of one key; the filter is applied before the aggregation and reaches the scan."""
    return live(log.where(F.col("key") == key))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Live versions of the listed keys (a column key)."""
    return live(log.join(keys.select("key").distinct(), "key", "left_semi"))


def range_scan(log: DataFrame, start: str, end: str, closed: bool = True) -> DataFrame:
    """Live keys in [start, end], or [start, end) if not closed; code point order."""
    upper = F.col("key") <= end if closed else F.col("key") < end
    return live(log.where((F.col("key") >= start) & upper))


def put(log: DataFrame, changes: DataFrame) -> DataFrame:
    """The log with changes (same columns) appended."""
    return log.unionByName(changes)


def stats(log: DataFrame) -> DataFrame:
    """Segments, live keys, changes and bytes of keys and values."""
    of_log = log.agg(F.countDistinct("segment_id").alias("segments"), F.count(F.lit(1)).alias("changes"), F.sum(F.octet_length("key") + F.lit(8)).alias("bytes"))
    return of_log.crossJoin(live(log).agg(F.count(F.lit(1)).alias("live_keys")))  # one row each


def compact(log: DataFrame, n: int = 2) -> DataFrame:
    """The log after merging the ``n`` oldest segments, never the newest one: of each key only the last change stays.

    A tombstone in the merged segments goes too; they are the oldest, so nothing older can come back."""
    segments = log.select("segment_id").distinct()
    last = log.agg(F.max("segment_id").alias("last"))  # one row
    old = F.broadcast(segments.crossJoin(last).where("segment_id < last").select("segment_id").orderBy("segment_id").limit(n))
    columns = [c for c in log.columns if c != "key"]
    merged = latest(log.join(old, "segment_id", "left_semi"), ["key"], "seq", columns).where("not deleted")
    return log.join(old, "segment_id", "left_anti").unionByName(merged)


def sparse_index(log: DataFrame, interval: int = 100) -> DataFrame:
    """Every ``interval``-th entry of each segment in key order."""
    rows = log.withColumn("place", F.row_number().over(W.partitionBy("segment_id").orderBy("key", "seq")))
    return rows.where((F.col("place") - 1) % interval == 0).select("segment_id", "key", "seq", "place")


def floor_entries(index: DataFrame, keys: DataFrame) -> DataFrame:
    """For each key the last index entry at or before it and the first after it, by segment (null beyond the ends). The
    wanted keys and the entries of a segment are read once in key order; each wanted key is listed once per segment, which
    is the size of the result."""
    entries = index.select("segment_id", "key", F.lit(0).alias("asked")).distinct()
    wanted = index.select("segment_id").distinct().crossJoin(keys.select("key").distinct()).select("segment_id", "key", F.lit(1).alias("asked"))
    order = W.partitionBy("segment_id").orderBy("key", "asked")
    entry = F.when(F.col("asked") == 0, F.col("key"))
    both = entries.unionByName(wanted).withColumns({"floor": F.last(entry, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)), "ceiling": F.first(entry, ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing))})
    return both.where("asked = 1").select("segment_id", F.col("key").alias("wanted"), "floor", "ceiling")


def segments_by_size(log: DataFrame, limit: int, partition: str) -> DataFrame:
    """Which segment each record of a writer falls into if a segment is closed when it has reached ``limit`` bytes."""
    size = F.octet_length("key") + F.lit(17)
    before = F.coalesce(F.sum(size).over(W.partitionBy(partition).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return log.withColumn("rolled", F.floor(before / limit).cast("long"))


def levels(log: DataFrame, ratio: int = 10, base: int = 1 << 14, most: int = 4) -> DataFrame:
    """Bytes of each level (a segment's level is the number of digits of its age, at most ``most``) and whether it is over its limit."""
    sized = log.groupBy("segment_id").agg(F.sum(F.octet_length("key") + F.lit(8)).alias("bytes"))
    newest = sized.agg(F.max("segment_id").alias("newest"))
    level = F.least(F.length((F.col("newest") - F.col("segment_id")).cast("string")) - 1, F.lit(most - 1))
    by_level = sized.crossJoin(newest).groupBy(level.alias("level")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("segments"))
    return by_level.withColumn("over", F.col("bytes") > F.lit(base) * F.pow(F.lit(ratio), F.col("level")))


def compact_level(log: DataFrame, level_of: Column, level: int, bottom: bool) -> DataFrame:
    """The log (with a column level) after the oldest segment of a level is merged into the next level: of each key of
    the merged segments the last change stays. Tombstones stay too, unless the next level is the bottom."""
    rows = log.withColumn("level", level_of)
    oldest = rows.where(F.col("level") == level).agg(F.min("segment_id").alias("_oldest"))
    merging = (F.col("level") == level + 1) | ((F.col("level") == level) & (F.col("segment_id") == F.col("_oldest")))
    marked = rows.crossJoin(oldest).withColumn("_m", F.coalesce(merging, F.lit(False))).drop("_oldest")
    merged = latest(marked.where("_m"), ["key"], "seq", [c for c in log.columns if c != "key"]).withColumn("level", F.lit(level + 1))
    merged = merged.where("not deleted") if bottom else merged
    return marked.where("not _m").drop("_m").unionByName(merged)


#: Bits of one block of a filter: 1024 words of 64.
BLOCK_BITS = 1 << 16


@dataclass(frozen=True)
class Bloom:
    """A filter in blocks of BLOCK_BITS bits: a row per block with its words. A key's bits all lie in the block that its
    hash picks, so a filter of any size is looked up by an equality join and never stands on one machine as a whole."""

    words: DataFrame
    blocks: int
    hashes: int


def _bits(key: Column, blocks: int, hashes: int) -> tuple[Column, Column]:
    """A key's block, and its bits in there by double hashing."""
    h1, h2 = F.pmod(F.xxhash64(key), F.lit(BLOCK_BITS)), F.pmod(F.xxhash64(key, F.lit(1)), F.lit(BLOCK_BITS // 2)) * 2 + 1
    bits = F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(h1 + i * h2, F.lit(BLOCK_BITS)).cast("int"))
    return F.pmod(F.xxhash64(key, F.lit(2)), F.lit(blocks)).cast("int"), bits


def bloom_filter(keys: DataFrame, rate: float = 0.01, count: int | None = None) -> Bloom:
    """A filter of the column key, sized for ``count`` keys (counted if not given) and a share of false positives."""
    n = max(count if count is not None else keys.select("key").distinct().count(), 1)
    bits = math.ceil(-n * math.log(rate) / math.log(2) ** 2)
    hashes = max(1, round(-math.log2(rate)))
    blocks = -(-bits // BLOCK_BITS)
    block, places = _bits(F.col("key"), blocks, hashes)
    set_ = keys.select(block.alias("block"), F.explode(places).alias("bit"))
    masks = set_.groupBy("block", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("mask"))
    held = masks.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("m"))  # 1024 words at most
    # One pass over the sorted words of a block makes them an array that a bit's word is found in at once.
    entries = F.array_sort(F.map_entries("m"))
    dense = F.aggregate(
        entries, F.array().cast("array<bigint>"),
        lambda done, e: F.concat(done, F.array_repeat(F.lit(0).cast("bigint"), e.key - F.size(done)), F.array(e.value)),
    )
    return Bloom(held.select("block", dense.alias("words")), blocks, hashes)


def might_contain(bloom: Bloom, keys: DataFrame) -> DataFrame:
    """``keys`` (a column key, and others) with maybe: false only of keys that the filter was not built on."""
    block, places = _bits(F.col("key"), bloom.blocks, bloom.hashes)
    asked = keys.withColumns({"block": block, "_bits": places}).join(bloom.words, "block", "left")
    there = F.forall("_bits", lambda b: F.coalesce(F.get("words", F.shiftright(b, 6)), F.lit(0).cast("bigint")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), b.bitwiseAND(F.lit(63)))) != 0)
    return asked.withColumn("maybe", F.coalesce(there, F.lit(False))).drop("block", "_bits", "words")


def entries_from(log: DataFrame, seq: int) -> DataFrame:
    """A write-ahead log from a sequence number on."""
    return log.where(F.col("seq") >= seq)


def gaps(log: DataFrame, partition: str) -> DataFrame:
    """Within each partition, the changes that do not follow their predecessor's number, and how many are missing."""
    before = F.lag("seq").over(W.partitionBy(partition).orderBy("seq"))
    return log.withColumn("missing", F.col("seq") - before - 1).where("missing > 0")


def apply_entries(log: DataFrame, applied_seq: int | Column) -> DataFrame:
    """State changes of the entries beyond ``applied_seq``; an entry that comes twice counts once."""
    fresh = log.where(F.col("seq") > applied_seq).dropDuplicates(["seq"])
    return latest(fresh, ["key"], "seq", ["value", "seq", "deleted"])
