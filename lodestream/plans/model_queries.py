"""Relational, document and graph queries over customers and the edges of the event log."""

from pyspark.sql import functions as F

from lodestream.operators import models as m
from lodestream.plans.views import EDGES, USERS, edges, users
from lodestream.tables import table

TEXTS = ("name", "segment")


def rel_filter_users(spark, sf_dir):
    """LIKE on the name, equality on the nation; an unknown key is ignored."""
    return users(spark, sf_dir).where(m.relational_filter({"name": "customer#00000_1", "nation": "7", "shoe_size": 44}, ("name", "segment"), ("nation",)))


def doc_filter_users(spark, sf_dir):
    """Substring of the name and the segment, nation as text."""
    u = users(spark, sf_dir)
    return u.where(m.document_filter(u.columns, {"name": "1", "segment": "MACH", "nation": 7}, TEXTS))


def doc_filter_unknown(spark, sf_dir):
    """Counts with a key that no document has (none match) and without it."""
    u = users(spark, sf_dir)
    with_key = F.count_if(m.document_filter(u.columns, {"segment": "build", "shoe_size": 44}, TEXTS))
    return u.agg(with_key.alias("with_unknown"), F.count_if(m.document_filter(u.columns, {"segment": "build"}, TEXTS)).alias("without"))


def graph_filter_nodes(spark, sf_dir):
    """Node properties with the number of typed edges that leave the node."""
    u = users(spark, sf_dir).where(m.document_filter(["name", "segment"], {"segment": "auto"}, TEXTS))
    out = edges(spark, sf_dir).groupBy(F.col("from_id").alias("id")).agg(F.count(F.lit(1)).alias("edges"))
    return u.join(out, "id", "left").select("id", "name", F.coalesce("edges", F.lit(0)).alias("edges"))


def user_get(spark, sf_dir):
    return users(spark, sf_dir).where("id = 42")


def _changes(spark):
    return spark.createDataFrame([(3, "Renamed", "BUILDING", 1, 10.0), (99999999, "New", "MACHINERY", 2, 20.0)], "id long, name string, segment string, nation int, balance double")


def user_upsert(spark, sf_dir):
    """All users after one is replaced and one is new."""
    return m.upsert(users(spark, sf_dir), _changes(spark), ["id"])


def user_merge(spark, sf_dir):
    """A shallow merge: null fields of the change leave the old value, unknown ids do nothing."""
    change = spark.createDataFrame([(3, "Renamed", None), (99999999, "New", "MACHINERY")], "id long, name string, segment string")
    return m.merge(users(spark, sf_dir), change, "id")


def user_delete(spark, sf_dir):
    """Users and edges left of the relational model after users with an id divisible by 10 are deleted."""
    gone = users(spark, sf_dir).where("id % 10 = 0").select("id")
    e = m.edges_without(edges(spark, sf_dir), gone)
    return e.groupBy("rel_type").agg(F.count(F.lit(1)).alias("edges"))


def doc_user_delete(spark, sf_dir):
    """The document model keeps edges to users that are gone."""
    gone = users(spark, sf_dir).where("id % 10 = 0").select("id")
    return m.edges_without(edges(spark, sf_dir), gone, both=False).groupBy("rel_type").agg(F.count(F.lit(1)).alias("edges"))


def relationships_by_type(spark, sf_dir):
    return m.relationships(edges(spark, sf_dir), 42, "click")


def relationships_all(spark, sf_dir):
    return m.relationships(edges(spark, sf_dir), 42)


def _edge_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("from_id"), F.get_json_object("props", "$.k").cast("long").alias("to_id"), F.col("event_type").alias("rel_type"), "event_id")


def relationship_upsert(spark, sf_dir):
    """Edges by their key, created when last added."""
    return m.unique_edges(_edge_log(spark, sf_dir), "event_id", last=True)


def relationship_first(spark, sf_dir):
    """Edges by their key, created when first added."""
    return m.unique_edges(_edge_log(spark, sf_dir), "event_id", last=False)


def user_overflow(spark, sf_dir):
    """Fields beyond id and name as one JSON object."""
    return m.overflow(users(spark, sf_dir).select("id", "name", "segment", "nation"), ["id", "name"])


def graph_traverse_d2(spark, sf_dir):
    return m.traverse(edges(spark, sf_dir), 5, None, 2)


def graph_traverse_typed(spark, sf_dir):
    return m.traverse(edges(spark, sf_dir), 5, "click", 3)


def graph_shortest_path(spark, sf_dir):
    """Distances from a node, and the smallest shortest path to each node."""
    few = edges(spark, sf_dir).where("rel_type = 'purchase'")
    return m.shortest_paths(few, 5, 3)


def graph_degree(spark, sf_dir):
    return m.degrees(edges(spark, sf_dir))


QUERIES = {f.__name__: f for f in (rel_filter_users, doc_filter_users, doc_filter_unknown, graph_filter_nodes, user_get, user_upsert, user_merge, user_delete, doc_user_delete, relationships_by_type, relationships_all, relationship_upsert, relationship_first, user_overflow, graph_traverse_d2, graph_traverse_typed, graph_shortest_path, graph_degree)}


def _bfs(where: str, depth: int) -> str:
    return f"""WITH RECURSIVE {EDGES}, s AS (SELECT DISTINCT from_id, to_id FROM edges {where}),
r AS (SELECT to_id AS id, 1 AS distance FROM s WHERE from_id = 5 UNION SELECT s.to_id, r.distance + 1 FROM r JOIN s ON r.id = s.from_id WHERE r.distance < {depth})
SELECT id, min(distance)::INT AS distance FROM r WHERE id <> 5 GROUP BY id"""


CHANGED = "SELECT 3::BIGINT AS id, 'Renamed' AS name, 'BUILDING' AS segment, 1::INT AS nation, 10.0::DOUBLE AS balance UNION ALL SELECT 99999999, 'New', 'MACHINERY', 2, 20.0"
ORACLES = {
    "rel_filter_users": f"WITH {USERS} SELECT * FROM users WHERE name ILIKE '%customer#00000_1%' AND nation = 7",
    "doc_filter_users": f"WITH {USERS} SELECT * FROM users WHERE contains(lower(name), '1') AND contains(lower(segment), 'mach') AND nation::VARCHAR = '7'",
    "doc_filter_unknown": f"WITH {USERS} SELECT 0::BIGINT AS with_unknown, count(*) AS without FROM users WHERE contains(lower(segment), 'build')",
    "graph_filter_nodes": f"WITH {USERS}, {EDGES} SELECT u.id, any_value(name) AS name, count(from_id) AS edges FROM users u LEFT JOIN edges e ON u.id = e.from_id WHERE contains(lower(segment), 'auto') GROUP BY u.id",
    "user_get": f"WITH {USERS} SELECT * FROM users WHERE id = 42",
    "user_upsert": f"WITH {USERS} SELECT * FROM users WHERE id <> 3 UNION ALL {CHANGED}",
    "user_merge": f"WITH {USERS} SELECT id, CASE WHEN id = 3 THEN 'Renamed' ELSE name END AS name, segment, nation, balance FROM users",
    "user_delete": f"WITH {USERS}, {EDGES} SELECT rel_type, count(*) AS edges FROM edges WHERE from_id NOT IN (SELECT id FROM users WHERE id % 10 = 0) AND to_id NOT IN (SELECT id FROM users WHERE id % 10 = 0) GROUP BY 1",
    "doc_user_delete": f"WITH {USERS}, {EDGES} SELECT rel_type, count(*) AS edges FROM edges WHERE from_id NOT IN (SELECT id FROM users WHERE id % 10 = 0) GROUP BY 1",
    "relationships_by_type": f'WITH {EDGES} SELECT to_id AS "to", rel_type AS type FROM edges WHERE from_id = 42 AND rel_type = \'click\'',
    "relationships_all": f'WITH {EDGES} SELECT to_id AS "to", rel_type AS type FROM edges WHERE from_id = 42',
    "relationship_upsert": "SELECT user_id AS from_id, (props->>'$.k')::BIGINT AS to_id, event_type AS rel_type, max(event_id) AS event_id FROM events GROUP BY 1, 2, 3",
    "relationship_first": "SELECT user_id AS from_id, (props->>'$.k')::BIGINT AS to_id, event_type AS rel_type, min(event_id) AS event_id FROM events GROUP BY 1, 2, 3",
    "user_overflow": f"""WITH {USERS} SELECT id, name, '{{"segment":"' || segment || '","nation":' || nation || '}}' AS metadata FROM users""",
    "graph_traverse_d2": _bfs("", 2),
    "graph_traverse_typed": _bfs("WHERE rel_type = 'click'", 3),
    "graph_shortest_path": f"""WITH RECURSIVE {EDGES}, s AS (SELECT DISTINCT from_id, to_id FROM edges WHERE rel_type = 'purchase'),
r AS (SELECT 5::BIGINT AS id, 0 AS distance, [5::BIGINT] AS path UNION ALL SELECT s.to_id, r.distance + 1, list_append(r.path, s.to_id) FROM r JOIN s ON r.id = s.from_id WHERE r.distance < 3),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, path) AS k FROM r)
SELECT id, distance::INT AS distance, array_to_string(path, '>') AS path FROM b WHERE k = 1""",
    "graph_degree": f"WITH {EDGES} SELECT id, sum(o)::BIGINT AS outgoing, sum(i)::BIGINT AS incoming FROM (SELECT from_id AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT to_id, 0, 1 FROM edges) GROUP BY id",
}
