"""Schema evolution. A registry is a table of fields (name, version, tag, field, type, required, default); fields are
matched by tag. Reading with another version is a projection: shared tags by the reader's names, defaults for what the
writer lacks, null for what is optional, nothing for tags the reader does not know."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "name string, version int, tag int, field string, type string, required boolean, default string"


def registry(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, FIELDS)


def latest(fields: DataFrame) -> DataFrame:
    """The newest version of each schema, its fields and all versions."""
    newest = fields.groupBy("name").agg(F.max("version").alias("latest"), F.array_join(F.array_sort(F.collect_set("version")).cast("array<string>"), ",").alias("versions"))
    return newest.join(fields, (fields.name == newest.name) & (fields.version == newest.latest)).groupBy(newest.name, "latest", "versions").agg(F.count(F.lit(1)).alias("fields"))


def compatibility(fields: DataFrame, name: str, old: int, new: int) -> DataFrame:
    """Problems by tag of reading old data with a new schema: a changed type, or a new required field without default."""
    a, b = (fields.where((F.col("name") == name) & (F.col("version") == v)) for v in (old, new))
    both = a.select("tag", F.col("type").alias("old_type")).join(b.select("tag", F.col("type").alias("new_type"), "required", "default"), "tag", "full")
    changed = F.col("old_type").isNotNull() & F.col("new_type").isNotNull() & (F.col("old_type") != F.col("new_type"))
    missing = F.col("old_type").isNull() & F.col("required") & F.col("default").isNull()
    problem = F.when(changed, F.concat(F.lit("type "), "old_type", F.lit(" to "), "new_type")).when(missing, "new required field without default")
    return both.withColumn("problem", problem).where("problem is not null").select("tag", "problem")


def read_as(rows: DataFrame, writer: dict[int, str], reader: dict[int, tuple[str, str, object]]) -> DataFrame:
    """Rows written with fields by tag, as the reader's (name, type, default) by tag."""
    return rows.select(*[(F.coalesce(F.col(writer[t]).cast(kind), F.lit(default).cast(kind)) if t in writer else F.lit(default).cast(kind)).alias(name) for t, (name, kind, default) in reader.items()])


def violations(row: dict[str, tuple[Column, str, bool]]) -> Column:
    """Names of the fields that are required and null, or whose whole number is out of its type's range."""
    limits = {"INT32": 2**31, "INT64": 2**63}
    found = []
    for name, (value, kind, required) in row.items():
        bad = value.isNull() if required else F.lit(False)
        if kind in limits:
            bad |= F.coalesce((value > limits[kind] - 1) | (value < -limits[kind]), F.lit(False))
        found.append(F.when(bad, F.lit(name)))
    return F.array_join(F.array_compact(F.array(*found)), ",")
