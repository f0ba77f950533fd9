"""JSON stores and sinks: documents in files of their own, graphs in one file, reduced pairs as lines."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """id and the document as a variant, of a folder with a JSON object per file."""
    text = spark.read.option("wholetext", True).text(folder)
    doc = F.try_parse_json("value")
    return text.select(F.try_variant_get(doc, "$._id", "string").alias("id"), doc.alias("doc")).where("doc is not null")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, properties) and edges (from_id, to_id, rel_type) of a JSON file {nodes: {...}, edges: {from: [{to, type}]}}."""
    whole = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "nodes map<string,string>, edges map<string,array<struct<to:string,type:string>>>").alias("g"))
    nodes = whole.select(F.explode("g.nodes").alias("id", "properties"))
    edges = whole.select(F.explode("g.edges").alias("from_id", "list")).select("from_id", F.explode("list").alias("e")).select("from_id", F.col("e.to").alias("to_id"), F.col("e.type").alias("rel_type"))
    return nodes, edges


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "rel_type")


def write_pairs(pairs: DataFrame, folder: str, partitions: int | None = None) -> None:
    """Lines {"k": ..., "v": ...}; with ``partitions`` so many files, dealt by key."""
    out = pairs.select("k", "v")
    (out.repartition(partitions, "k") if partitions else out).write.mode("overwrite").json(folder)


def write_named(reduced: DataFrame, folder: str) -> None:
    """(reducer, k, v) with a folder per reducer."""
    reduced.write.mode("overwrite").partitionBy("reducer").json(folder)
