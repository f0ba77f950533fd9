"""Three data models over one user table: relational rows, documents, property graph. Filters are dictionaries, turned
into one conjunction of column predicates, so they reach the scan."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def relational_filter(filters: Mapping[str, object], like: tuple[str, ...] = ("name", "email"), equal: tuple[str, ...] = ("age",)) -> Column:
    """Known keys only: LIKE %v% without regard to case (% and _ are wildcards), or equality as a whole number."""
    out = F.lit(True)
    for key, value in filters.items():
        if key in like:
            out &= F.col(key).ilike(f"%{value}%")
        elif key in equal:
            out &= F.col(key) == int(str(value))
    return out


def document_filter(columns: list[str], filters: Mapping[str, object], strings: tuple[str, ...]) -> Column:
    """Every key counts: a missing one matches nothing; strings contain the value without regard to case, others equal it as text."""
    out = F.lit(True)
    for key, value in filters.items():
        if key not in columns:
            return F.lit(False)
        if key in strings:
            out &= F.contains(F.lower(key), F.lit(str(value).lower()))
        else:
            out &= F.col(key).cast("string") == str(value)
    return out


def upsert(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replaced or added by key; the change wins."""
    return rows.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def merge(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Existing rows with the non-null fields of their change; changes of unknown keys do nothing."""
    fields = [c for c in changes.columns if c != key]
    joined = rows.join(changes.select(key, *[F.col(c).alias(f"_{c}") for c in fields]), key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns])


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(F.col(gone.columns[0]).alias(key)), key, "left_anti")


def edges_without(edges: DataFrame, gone: DataFrame, both: bool = True) -> DataFrame:
    """Edges left when nodes go: relational and graph stores drop both directions, the document store the outgoing ones."""
    left = without(edges, gone, "from_id")
    return without(left, gone, "to_id") if both else left


def relationships(edges: DataFrame, node: object, rel_type: str | None = None) -> DataFrame:
    out = edges.where(F.col("from_id") == node)
    return (out.where(F.col("rel_type") == rel_type) if rel_type else out).select(F.col("to_id").alias("to"), F.col("rel_type").alias("type"))


def unique_edges(edges: DataFrame, order: str, last: bool) -> DataFrame:
    """One edge per (from, to, type): the last (relational) or the first (document, graph) that was added."""
    pick = F.max if last else F.min
    return edges.groupBy("from_id", "to_id", "rel_type").agg(pick(order).alias(order))


def overflow(rows: DataFrame, known: list[str], out: str = "metadata") -> DataFrame:
    """Known columns, and all others as one JSON object (null fields left out)."""
    return rows.select(*known, F.to_json(F.struct(*[c for c in rows.columns if c not in known])).alias(out))


def traverse(edges: DataFrame, start: object, rel_type: str | None, depth: int) -> DataFrame:
    """Nodes within ``depth`` steps of the start, without it, with their least distance."""
    steps = (edges.where(F.col("rel_type") == rel_type) if rel_type else edges).select("from_id", "to_id").distinct()
    frontier = steps.where(F.col("from_id") == start).select(F.col("to_id").alias("id")).distinct().where(F.col("id") != start).withColumn("distance", F.lit(1))
    seen = frontier
    for d in range(2, depth + 1):
        reached = frontier.join(steps, frontier.id == steps.from_id).select(F.col("to_id").alias("id")).distinct().where(F.col("id") != start)
        frontier = reached.join(seen, "id", "left_anti").withColumn("distance", F.lit(d))
        seen = seen.unionByName(frontier)
    return seen


def shortest_paths(edges: DataFrame, start: object, depth: int) -> DataFrame:
    """For each node within ``depth`` steps its distance and the smallest shortest path (by node ids), as text."""
    steps = edges.select("from_id", "to_id").distinct()
    here = edges.sparkSession.createDataFrame([(start,)], "id long").select("id", F.lit(0).alias("distance"), F.array("id").alias("path"))
    seen, frontier = here, here
    for d in range(1, depth + 1):
        reached = frontier.join(steps, frontier.id == steps.from_id).select(F.col("to_id").alias("id"), F.concat("path", F.array("to_id")).alias("path"))
        best = reached.groupBy("id").agg(F.min("path").alias("path"))  # arrays compare element by element
        frontier = best.join(seen, "id", "left_anti").select("id", F.lit(d).alias("distance"), "path")
        seen = seen.unionByName(frontier)
    return seen.select("id", "distance", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def degrees(edges: DataFrame) -> DataFrame:
    """Outgoing and incoming edges of every node, from the edges and their reverse."""
    both = edges.select(F.col("from_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("to_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("id").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


def ranked(df: DataFrame, partition: str, order: list[Column]) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.partitionBy(partition).orderBy(*order)))
