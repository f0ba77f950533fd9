"""The user service's verbs over DataFrames: each answers a status and a body; writes replace the tables they change."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.operators import models


class UserApi:
    """users (id and fields) and edges (from_id, to_id, rel_type). ``strings``: fields compared by substring;
    ``both``: whether deleting a user also drops edges to it."""

    def __init__(self, users: DataFrame, edges: DataFrame, strings: tuple[str, ...] = ("name", "email"), both: bool = True):
        self.users, self.edges, self.strings, self.both = users, edges, strings, both

    def _rows(self, data: dict) -> DataFrame:
        schema = self.users.schema
        return self.users.sparkSession.createDataFrame([tuple(data.get(f.name) for f in schema)], schema)

    def get(self, user_id: object) -> tuple[int, dict | None]:
        found = self.users.where(F.col("id") == user_id).limit(1).collect()
        return (200, found[0].asDict()) if found else (404, None)

    def find(self, filters: dict) -> tuple[int, DataFrame]:
        return 200, self.users.where(models.document_filter(self.users.columns, filters, self.strings))

    def relationships(self, user_id: object, rel_type: str | None = None) -> tuple[int, DataFrame]:
        return 200, models.relationships(self.edges, user_id, rel_type)

    def create(self, data: dict) -> tuple[int, dict | None]:
        if data.get("id") is None:
            return 400, None
        self.users = models.upsert(self.users, self._rows(data), ["id"])
        return 201, data

    def add_relationship(self, user_id: object, data: dict) -> tuple[int, dict | None]:
        if not data.get("to") or not data.get("type"):
            return 400, None
        edge = self.edges.sparkSession.createDataFrame([(user_id, data["to"], data["type"])], self.edges.select("from_id", "to_id", "rel_type").schema)
        self.edges = self.edges.select("from_id", "to_id", "rel_type").unionByName(edge).distinct()
        return 201, data

    def update(self, user_id: object, data: dict) -> tuple[int, dict]:
        self.users = models.merge(self.users, self._rows(data | {"id": user_id}), "id")
        return 200, data

    def delete(self, user_id: object) -> tuple[int, None]:
        gone = self.users.sparkSession.createDataFrame([(user_id,)], self.users.select("id").schema)
        self.users, self.edges = models.without(self.users, gone, "id"), models.edges_without(self.edges, gone, self.both)
        return 200, None
