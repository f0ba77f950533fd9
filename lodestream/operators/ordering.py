"""Exact positions in an order, without one task per group."""

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def numbered(df: DataFrame, group: list[str], order: list[str], out: str = "number") -> DataFrame:
    """``df`` with each row's place (from 0) in its group. Rows are dealt by ranges of group and order; a row's place is
    its place in its range plus the sizes of the group's earlier ranges, so a group with a third of all rows is spread
    over many tasks. The ranged rows are kept on disk, since both halves must see the same ranges."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *group, *order).withColumn("_range", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    sizes = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))  # a row per group and range
    earlier = F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*group, "_range", earlier.alias("_offset"))
    local = F.row_number().over(W.partitionBy(*group, "_range").orderBy(*order)) - 1
    return ranged.withColumn("_local", local).join(offsets, [*group, "_range"]).withColumn(out, F.col("_local") + F.col("_offset")).drop("_range", "_local", "_offset")
