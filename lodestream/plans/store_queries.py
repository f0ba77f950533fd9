"""Stores on disk: written to the shared folder in their own formats and read back whole."""

from pyspark.sql import functions as F

from lodestream.operators import codec as cd
from lodestream.operators import routing as rt
from lodestream.operators.changelog import latest
from lodestream.plans.views import KV_LOG, SHARD_ROWS, USERS, kv_log, shard_rows, users
from lodestream.shared import shared_path
from lodestream.sources import logs, stores

NODES = [f"node{i}" for i in range(5)]


def log_segments_roundtrip(spark, sf_dir):
    """The changelog as binary segment files: live keys as read back from them, by the files' own order."""
    path = shared_path(spark, "segments")
    logs.write_segments(kv_log(spark, sf_dir).withColumn("value", F.col("value").cast("string")), path)
    read = logs.read_segments(spark, path)
    return latest(read, ["key"], "seq", ["value", "deleted"]).where("not deleted").select("key", F.col("value").cast("double").alias("value"))


def log_wal_roundtrip(spark, sf_dir):
    """The changelog as binary write-ahead files: entries by operation and key as read back."""
    path = shared_path(spark, "wal")
    log = kv_log(spark, sf_dir).withColumns({"value": F.col("value").cast("string"), "op": F.when(F.col("deleted"), logs.DELETE).otherwise(logs.PUT), "t": F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000})
    logs.write_wal(log, path)
    return logs.read_wal(spark, path).groupBy("key", "op").agg(F.count(F.lit(1)).alias("entries"), F.max("seq").alias("last_seq"))


def doc_store_roundtrip(spark, sf_dir):
    """Users as JSON documents, one to a line of a text store, and fields of them as read back."""
    path = shared_path(spark, "documents")
    users(spark, sf_dir).select(F.to_json(F.struct(F.col("id").cast("string").alias("_id"), "name", F.struct("segment", "nation").alias("profile")))).write.text(path)
    doc = F.try_parse_json("value")
    read = spark.read.text(path).select(doc.alias("doc"))
    return read.select(F.try_variant_get("doc", "$._id", "string").cast("long").alias("id"), F.try_variant_get("doc", "$.name", "string").alias("name"), F.try_variant_get("doc", "$.profile.nation", "int").alias("nation"))


def reduce_output_roundtrip(spark, sf_dir):
    """Pairs as lines of JSON, dealt by key into seven files, as read back."""
    path = shared_path(spark, "pairs")
    pairs = kv_log(spark, sf_dir).groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("v"))
    stores.write_pairs(pairs, path, 7)
    return spark.read.schema("k string, v long").json(path)


ITEM = cd.Schema("Item", 1, (cd.Field(1, "sku", "STRING", True), cd.Field(2, "count", "INT32")))
ORDER = cd.Schema("Order", 1, (cd.Field(1, "id", "INT64", True), cd.Field(2, "big", "BOOL"), cd.Field(3, "rate", "FLOAT32"), cd.Field(4, "raw", "BYTES"), cd.Field(5, "tags", "ARRAY", item="STRING"), cd.Field(6, "notes", "MAP"), cd.Field(7, "item", "NESTED", item=ITEM)))
WIDER = cd.Schema("Item", 2, (cd.Field(1, "sku", "STRING", True), cd.Field(3, "price", "FLOAT64", default=0.0)))
ORDER_2 = cd.Schema("Order", 2, (cd.Field(1, "id", "INT64", True), cd.Field(2, "big", "BOOL"), cd.Field(3, "rate", "FLOAT32"), cd.Field(4, "raw", "BYTES"), cd.Field(5, "tags", "ARRAY", item="STRING"), cd.Field(6, "notes", "MAP"), cd.Field(7, "item", "NESTED", item=WIDER)))


def _orders(spark, sf_dir):
    u = users(spark, sf_dir)
    return u.select(
        "id", (F.col("nation") > 12).alias("big"), (F.col("nation") / 4).cast("float").alias("rate"), F.encode("segment", "UTF-8").alias("raw"), F.array("segment", F.lit("x")).alias("tags"),
        F.create_map(F.lit("n"), F.col("nation").cast("string")).alias("notes"), F.struct(F.col("name").alias("sku"), F.col("nation").cast("int").alias("count")).alias("item"),
    )


def codec_nested_evolution(spark, sf_dir):
    """Records of all field types, whose nested part is read with a newer schema: a field is gone, one has its default."""
    written = cd.encoded(_orders(spark, sf_dir), ORDER)
    types = "id long, big boolean, rate float, raw binary, tags array<string>, notes map<string,string>, item struct<sku:string,price:double>"
    read = cd.decoded(written, "record", {("Order", 1): ORDER}, ORDER_2, types)
    return read.select("id", "big", F.col("rate").cast("double").alias("rate"), F.decode("raw", "UTF-8").alias("raw"), F.array_join("tags", ",").alias("tags"), F.col("notes")["n"].alias("note"), F.col("item.sku").alias("sku"), F.col("item.price").alias("price"))


def routed_writes(spark, sf_dir):
    """A batch of puts (every order, its price doubled if it is closed) and deletes (open ones), each sent to the node that
    owns its key; rows and sums by node as they stand after it."""
    from lodestream.tables import table

    before = rt.owners(shard_rows(spark, sf_dir), NODES).select("owner", "key", F.lit(0).alias("seq"), "value", F.lit(False).alias("deleted"))
    state = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    batch = state.select(F.col("o_orderkey").cast("string").alias("key"), F.lit(1).alias("seq"), (F.col("o_totalprice") * 2).alias("value"), (F.col("o_orderstatus") == "O").alias("deleted"))
    after = latest(before.unionByName(rt.owners(batch, NODES)), ["owner", "key"], "seq", ["value", "deleted"]).where("not deleted")
    return after.groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


QUERIES = {f.__name__: f for f in (log_segments_roundtrip, log_wal_roundtrip, doc_store_roundtrip, reduce_output_roundtrip, codec_nested_evolution, routed_writes)}
RING = ", ".join(f"('{p}', '{n}')" for p, n in rt.ring(NODES))
ORACLES = {
    "log_segments_roundtrip": f"WITH {KV_LOG} SELECT key, value FROM kv_log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1 AND NOT deleted",
    "log_wal_roundtrip": f"WITH {KV_LOG} SELECT key, CASE WHEN deleted THEN 2 ELSE 1 END AS op, count(*) AS entries, max(seq) AS last_seq FROM kv_log GROUP BY ALL",
    "doc_store_roundtrip": f"WITH {USERS} SELECT id, name, nation FROM users",
    "reduce_output_roundtrip": f"WITH {KV_LOG} SELECT key AS k, count(*) AS v FROM kv_log GROUP BY 1",
    "codec_nested_evolution": f"WITH {USERS} SELECT id, nation > 12 AS big, (nation / 4)::FLOAT::DOUBLE AS rate, segment AS raw, segment || ',x' AS tags, nation::VARCHAR AS note, name AS sku, 0.0::DOUBLE AS price FROM users",
    "routed_writes": f"""WITH {SHARD_ROWS}, ring(pos, node) AS (VALUES {RING}), s AS (SELECT key, CASE WHEN o_orderstatus = 'F' THEN value * 2 ELSE value END AS value FROM shard_rows JOIN orders ON o_orderkey::VARCHAR = key WHERE o_orderstatus <> 'O'),
h AS (SELECT *, md5(key) AS h FROM s), o AS (SELECT h.*, coalesce(r.node, (SELECT min_by(node, pos) FROM ring)) AS owner FROM h ASOF LEFT JOIN ring r ON h.h < r.pos)
SELECT owner, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM o GROUP BY owner""",
}
