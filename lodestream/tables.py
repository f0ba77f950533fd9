"""Readers for the driver's Parquet tables."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in ``sf_dir``; only Spark's reader touches the path, so any Hadoop file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
