"""Schema evolution and the record codec over customers."""

from pyspark.sql import functions as F

from lodestream.operators import codec as cd
from lodestream.operators import evolution as ev
from lodestream.plans.views import USERS, users

#: name, version, tag, field, type, required, default
ROWS = [
    ("User", 1, 1, "id", "INT64", True, None), ("User", 1, 2, "name", "STRING", True, None), ("User", 1, 3, "email", "STRING", False, None),
    ("User", 2, 1, "id", "INT64", True, None), ("User", 2, 2, "name", "STRING", True, None), ("User", 2, 3, "email", "STRING", False, None), ("User", 2, 4, "age", "INT32", False, "0"), ("User", 2, 5, "tags", "ARRAY", False, "[]"),
    ("User", 3, 1, "id", "INT64", True, None), ("User", 3, 2, "name", "STRING", True, None), ("User", 3, 4, "age", "INT32", False, "0"), ("User", 3, 5, "tags", "ARRAY", False, "[]"), ("User", 3, 6, "metadata", "MAP", False, "{}"),
    ("User", 99, 1, "id", "STRING", True, None), ("User", 99, 9, "token", "STRING", True, None),
    ("Address", 1, 1, "street", "STRING", False, None), ("Address", 1, 2, "city", "STRING", False, None), ("Address", 1, 3, "zip", "STRING", False, None),
]
V1 = cd.Schema("User", 1, (cd.Field(1, "id", "INT64", True), cd.Field(2, "name", "STRING", True), cd.Field(3, "segment", "STRING"), cd.Field(4, "balance", "FLOAT64")))
V2 = cd.Schema("User", 2, (cd.Field(1, "id", "INT64", True), cd.Field(2, "full_name", "STRING", True), cd.Field(4, "balance", "FLOAT64"), cd.Field(5, "age", "INT32", default=0)))


def schema_latest(spark, sf_dir):
    return ev.latest(ev.registry(spark, ROWS))


def _compatible(old, new):
    def query(spark, sf_dir):
        return ev.compatibility(ev.registry(spark, ROWS), "User", old, new)

    query.__doc__ = f"Problems of reading version {old} as version {new}."
    return query


def schema_upgrade_defaults(spark, sf_dir):
    """Old rows as a newer reader sees them: defaults for new fields."""
    return ev.read_as(users(spark, sf_dir), {1: "id", 2: "name", 3: "segment"}, {1: ("id", "long", None), 2: ("name", "string", None), 3: ("segment", "string", None), 4: ("age", "int", 0), 5: ("tags", "string", "[]")})


def schema_downgrade(spark, sf_dir):
    """New rows as an older reader sees them: unknown fields are gone, a renamed one has its old name."""
    return ev.read_as(users(spark, sf_dir), {1: "id", 2: "name", 3: "segment", 4: "nation"}, {1: ("id", "long", None), 2: ("label", "string", None)})


def schema_validate(spark, sf_dir):
    """Rows whose required fields are missing or whose numbers do not fit, by what is wrong."""
    u = users(spark, sf_dir).select("id", F.when(F.col("id") % 5 > 0, F.col("name")).alias("name"), (F.col("id") * 4_000_000).alias("score"))
    wrong = ev.violations({"id": (F.col("id"), "INT64", True), "name": (F.col("name"), "STRING", True), "score": (F.col("score"), "INT32", False)})
    return u.withColumn("wrong", wrong).groupBy("wrong").agg(F.count(F.lit(1)).alias("n"))


def codec_roundtrip(spark, sf_dir):
    """Customers written with one version and read with another."""
    u = users(spark, sf_dir).select("id", "name", "segment", F.when(F.col("id") % 3 > 0, F.col("balance")).alias("balance"))
    written = cd.encoded(u, V1)
    return cd.decoded(written, "record", {("User", 1): V1}, V2, "id long, full_name string, balance double, age int")


def codec_bytes(spark, sf_dir):
    """The bytes of records of two fields, as hexadecimal digits."""
    small = cd.Schema("U", 1, (cd.Field(1, "id", "INT64", True), cd.Field(2, "name", "STRING", True)))
    rows = cd.encoded(users(spark, sf_dir).select("id", "name"), small, keep=("id",))
    return rows.select("id", F.lower(F.hex("record")).alias("record"))


QUERIES = {f.__name__: f for f in (schema_latest, schema_upgrade_defaults, schema_downgrade, schema_validate, codec_roundtrip, codec_bytes)}
QUERIES |= {f"schema_compat_{a}_{b}": _compatible(a, b) for a, b in ((1, 2), (2, 3), (1, 99))}


def _sql(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'"


FIELDS_SQL = "fields(name, version, tag, field, type, required, dflt) AS (VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in ROWS) + ")"
COMPAT = """WITH {f}, a AS (FROM fields WHERE name = 'User' AND version = {o}), b AS (FROM fields WHERE name = 'User' AND version = {n}),
p AS (SELECT coalesce(a.tag, b.tag)::INT AS tag, CASE WHEN a.type <> b.type THEN 'type ' || a.type || ' to ' || b.type WHEN a.tag IS NULL AND b.required AND b.dflt IS NULL THEN 'new required field without default' END AS problem FROM a FULL JOIN b ON a.tag = b.tag)
SELECT * FROM p WHERE problem IS NOT NULL"""
ORACLES = {
    "schema_latest": f"WITH {FIELDS_SQL}, l AS (SELECT name, max(version)::INT AS latest, array_to_string(list_sort(list(DISTINCT version::VARCHAR)), ',') AS versions FROM fields GROUP BY 1) SELECT l.*, (SELECT count(*) FROM fields f WHERE f.name = l.name AND f.version = l.latest) AS fields FROM l",
    "schema_upgrade_defaults": f"WITH {USERS} SELECT id, name, segment, 0::INT AS age, '[]' AS tags FROM users",
    "schema_downgrade": f"WITH {USERS} SELECT id, name AS label FROM users",
    "schema_validate": f"WITH {USERS} SELECT array_to_string(list_filter([CASE WHEN id % 5 = 0 THEN 'name' END, CASE WHEN id * 4000000 >= 2147483648 THEN 'score' END], lambda x: x IS NOT NULL), ',') AS wrong, count(*) AS n FROM users GROUP BY 1",
    "codec_roundtrip": f"WITH {USERS} SELECT id, name AS full_name, CASE WHEN id % 3 > 0 THEN balance END AS balance, 0::INT AS age FROM users",
    "codec_bytes": f"WITH {USERS} SELECT id, '56454e43' || '0001' || '0001' || '55' || '01' || printf('%016x', id) || '02' || printf('%02x', strlen(name)) || lower(hex(name)) || '00' AS record FROM users",
} | {f"schema_compat_{a}_{b}": COMPAT.format(f=FIELDS_SQL, o=a, n=b) for a, b in ((1, 2), (2, 3), (1, 99))}
