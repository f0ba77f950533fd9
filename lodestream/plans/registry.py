"""All queries of the engine's own operators, with their SQL oracles."""

from lodestream.plans import changelog_queries, evolution_queries, mapreduce_queries, model_queries, replication_queries, routing_queries, state_queries, store_queries, stream_queries

PARTS = (mapreduce_queries, model_queries, changelog_queries, routing_queries, state_queries, replication_queries, evolution_queries, store_queries, stream_queries)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
