"""Worked examples and properties of the operators."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.operators import changelog, codec, mapreduce, models, mvcc, replication, routing
from lodestream.plans.views import kv_log
from lodestream.sources import logs, stores

SMALL = "/root/testdata/sf0.001"


def test_word_count_of_lines(spark):
    text = spark.createDataFrame([("  hello world",), ("hello hadoop",), ("hello mapreduce world　",), ("distributed systems",), (" \x1c ",), ("don't",)], "value string")
    got = {r.k: r.n for r in mapreduce.word_pairs(mapreduce.lines(text)).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"hello": 3, "world": 2, "hadoop": 1, "mapreduce": 1, "distributed": 1, "systems": 1, "dont": 1}


def test_url_domains(spark):
    lines = ['{"url": "http://a.b:80/x"}', '{"url": "https://u@h?q=1"}', '{"url": "no scheme"}', "{broken", '{"url": null}', '{"url": "file:///x"}']
    got = [r.k for r in mapreduce.url_pairs(spark.createDataFrame([(x,) for x in lines], "line string"), "line").collect()]
    assert sorted(got) == ["", "a.b:80", "u@h?q=1"]


def test_tabbed_lines(spark):
    rows = spark.createDataFrame([("d1\ta b",), ("no tab",), ("d2\tb\tc",)], "line string")
    assert sorted(tuple(r) for r in mapreduce.tabbed(rows).collect()) == [("d1", "a b"), ("d2", "b\tc")]


def test_md5_partition_is_that_of_the_whole_number(spark):
    import hashlib

    keys = [f"key_{i}" for i in range(50)] + ["", "é"]
    got = {r.key: r.p for r in spark.createDataFrame([(k,) for k in keys], "key string").select("key", mapreduce.partition_of(F.col("key"), 7).alias("p")).collect()}
    assert got == {k: int(hashlib.md5(k.encode()).hexdigest(), 16) % 7 for k in keys}


def test_thousand_keys_and_a_deletion(spark):
    log = spark.range(1000).select(F.col("id").alias("seq"), F.format_string("key_%04d", "id").alias("key"), F.concat(F.lit("value_"), F.col("id").cast("string")).alias("value"), F.lit(False).alias("deleted"))
    gone = spark.createDataFrame([(1000, "key_0500", None, True)], "seq long, key string, value string, deleted boolean")
    state = changelog.live(changelog.put(log, gone))
    assert state.count() == 999 and state.where("key = 'key_0500'").count() == 0
    assert changelog.range_scan(log, "key_0100", "key_0110").count() == 11
    assert changelog.range_scan(log, "key_0100", "key_0110", closed=False).count() == 10


def test_compaction_keeps_the_live_view(spark):
    log = kv_log(spark, SMALL).withColumn("segment_id", F.floor(F.col("seq") / 100))
    compacted = changelog.compact(log)
    assert compacted.count() < log.count()
    view = lambda x: {tuple(r) for r in changelog.live(x).collect()}
    assert view(compacted) == view(log)
    again = changelog.compact(compacted)
    assert view(again) == view(log)
    assert compacted.where("segment_id = 9").count() == log.where("segment_id = 9").count()  # the newest stays


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    half = keys.where("cast(substring(key, 2) as int) % 2 = 0")
    got = changelog.might_contain(changelog.bloom_filter(half), keys).collect()
    maybe = {r.key for r in got if r.maybe}
    assert all(f"k{i}" in maybe for i in range(0, 2000, 2)) and len(maybe) < 1600


def test_ring_split_of_a_hundred_keys(spark):
    keys = spark.range(100).select(F.concat(F.lit("key_"), F.col("id").cast("string")).alias("key"))
    owned = routing.owners(keys, ["0", "1", "2"])
    assert owned.count() == 100
    nodes = ["shard_0", "shard_1", "shard_2"]
    before = {r.key: r.owner for r in routing.owners(keys, nodes).collect()}
    after = {r.key: r.owner for r in routing.owners(keys, [*nodes, "shard_3"]).collect()}
    assert all(after[k] in (before[k], "shard_3") for k in before)  # only the new node takes keys
    first = {r.key: r.node for r in routing.replicas(keys, nodes, 3).where("place = 0").collect()}
    assert first == before
    assert routing.replicas(keys, nodes, 3).groupBy("key").agg(F.countDistinct("node").alias("n")).where("n <> 3").count() == 0


def test_lookup_agrees_with_a_sorted_ring(spark):
    import hashlib
    from bisect import bisect_right

    at = routing.ring(["a", "b"], 20)
    got = routing.owners(spark.range(300).select(F.col("id").cast("string").alias("key")), ["a", "b"], 20).collect()
    for r in got:
        k = bisect_right([p for p, _ in at], hashlib.md5(r.key.encode()).hexdigest())
        assert r.owner == at[k % len(at)][1]


@pytest.mark.parametrize("merge", ["inc", "dec"])
def test_counter_join_is_idempotent_and_commutative(spark, merge):
    a = spark.createDataFrame([("n0", 5, 1), ("n1", 2, 0)], "node string, inc long, dec long")
    b = spark.createDataFrame([("n0", 3, 4), ("n2", 7, 0)], "node string, inc long, dec long")
    joined = lambda *xs: {tuple(r) for r in replication.max_per_node(xs[0] if len(xs) == 1 else xs[0].union(xs[1]), ["node"], ["inc", "dec"]).collect()}
    assert joined(a, b) == joined(b, a) == {("n0", 5, 4), ("n1", 2, 0), ("n2", 7, 0)}
    assert joined(a, a) == joined(a)


def test_write_skew_and_lost_updates_show_as_conflicts(spark):
    rows = [(1, 10, 0, 100), (1, 11, 50, 150), (2, 12, 200, 300), (1, 13, 160, 170)]
    got = {r.txn_id: r.conflicts for r in mvcc.open_before(spark.createDataFrame(rows, "key long, txn_id long, start_ts long, commit_ts long")).collect()}
    assert got == {10: 0, 11: 1, 12: 0, 13: 0}
    reads = spark.createDataFrame([("x", 1, 0, 10), ("y", 1, 0, 10), ("x", 2, 5, 12), ("y", 2, 5, 12)], "key string, txn_id long, start_ts long, commit_ts long")
    writes = spark.createDataFrame([("x", 1, 0, 10), ("y", 2, 5, 12)], "key string, txn_id long, start_ts long, commit_ts long")
    edges = mvcc.rw_edges(reads, writes, 3)
    assert {tuple(r) for r in edges.collect()} == {(1, 2), (2, 1)}
    assert {r.txn_id for r in mvcc.dangerous(edges).collect()} == {1, 2}


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_as_of_reads_do_not_depend_on_the_buckets(spark, width):
    versions = spark.createDataFrame([("a", t, i, i % 3 == 0) for i, t in enumerate(range(0, 60, 4))] + [("b", 30, 99, False)], "key string, commit_ts long, txn_id long, deleted boolean")
    reads = spark.createDataFrame([("a", t) for t in range(-1, 70, 3)] + [("b", 29), ("b", 30), ("c", 5)], "key string, read_ts long")
    got = {(r.key, r.read_ts): r.txn_id for r in mvcc.as_of(reads, versions, ["txn_id", "deleted"], width).collect()}
    want = {("a", t): (min(t // 4, 14) if t >= 0 else None) for t in range(-1, 70, 3)} | {("b", 29): None, ("b", 30): 99, ("c", 5): None}
    assert got == want


def test_traversal_and_paths(spark):
    edges = spark.createDataFrame([(1, 2, "f"), (2, 3, "f"), (3, 1, "f"), (3, 4, "g"), (1, 5, "f"), (5, 4, "f")], "from_id long, to_id long, rel_type string")
    assert {tuple(r) for r in models.traverse(edges, 1, "f", 3).collect()} == {(2, 1), (5, 1), (3, 2), (4, 2)}
    got = {r.id: (r.distance, r.path) for r in models.shortest_paths(edges, 1, 3).collect()}
    assert got == {1: (0, "1"), 2: (1, "1>2"), 5: (1, "1>5"), 3: (2, "1>2>3"), 4: (2, "1>5>4")}


def test_user_service(spark):
    from lodestream.operators.user_api import UserApi

    users = spark.createDataFrame([("alice", "Alice", "alice@example.com", 30)], "id string, name string, email string, age int")
    api = UserApi(users, spark.createDataFrame([], "from_id string, to_id string, rel_type string"))
    assert api.create({"name": "x"})[0] == 400 and api.create({"id": "bob", "name": "Bob", "age": 4})[0] == 201
    assert api.get("bob") == (200, {"id": "bob", "name": "Bob", "email": None, "age": 4}) and api.get("eve")[0] == 404
    assert api.add_relationship("alice", {"to": "bob"})[0] == 400
    for _ in range(2):
        assert api.add_relationship("alice", {"to": "bob", "type": "follows"})[0] == 201
    assert [tuple(r) for r in api.relationships("alice", "follows")[1].collect()] == [("bob", "follows")]
    assert api.update("alice", {"age": 31})[0] == 200 and api.get("alice")[1]["age"] == 31 and api.get("alice")[1]["name"] == "Alice"
    assert api.update("nobody", {"age": 1})[0] == 200 and api.get("nobody")[0] == 404
    assert [r.id for r in api.find({"name": "AL", "age": 31})[1].collect()] == ["alice"] and api.find({"shoe": 1})[1].count() == 0
    assert api.delete("bob")[0] == 200 and api.relationships("alice")[1].count() == 0 and api.delete("bob")[0] == 200


def test_places_in_an_order(spark):
    from lodestream.operators.ordering import numbered

    rows = [("hot", i * 7919 % 1000) for i in range(1000)] + [("few", 3), ("few", 1)]
    got = {(r.g, r.v): r.number for r in numbered(spark.createDataFrame(rows, "g string, v long"), ["g"], ["v"]).collect()}
    assert got == {("hot", i): i for i in range(1000)} | {("few", 1): 0, ("few", 3): 1}


def test_nearest_rank(spark):
    for n in (1, 2, 10, 100):
        df = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("v"))
        r = replication.nearest_rank(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).first()
        assert (r.p50, r.p95) == (n // 2, int(n * 0.95))


def test_level_compaction_keeps_the_live_view(spark):
    log = kv_log(spark, SMALL).withColumn("segment_id", F.floor(F.col("seq") / 100))
    level = F.floor((9 - F.col("segment_id")) / 4)
    view = lambda x: {tuple(r) for r in changelog.live(x).collect()}
    for bottom in (False, True):
        assert view(changelog.compact_level(log, level, 1, bottom)) == view(log)
    assert view(changelog.compact_level(log, level, 0, False)) == view(log)


def test_binary_logs(spark, tmp_path):
    (tmp_path / "seg").mkdir()
    parts = [[("a", "1"), ("b", ""), ("é", "ü")], [("a", None), ("c", "3")]]
    for i, records in enumerate(parts):
        data = b"".join(logs.segment_record(k, v) for k, v in records)
        (tmp_path / "seg" / f"segment_{i}.log").write_bytes(data + (b"\0\0\0\5\0" if i else b""))  # the last record is cut off
    rows = logs.read_segments(spark, str(tmp_path / "seg"))
    assert {(r.key, r.value) for r in changelog.live(rows).collect()} == {("b", ""), ("é", "ü"), ("c", "3")}
    (tmp_path / "wal").mkdir()
    (tmp_path / "wal" / "x.wal").write_bytes(b"".join(logs.wal_entry(i, logs.PUT if i < 3 else logs.DELETE, f"key_{i}", "" if i == 1 else f"v{i}", i / 2) for i in range(4)))
    got = sorted(tuple(r) for r in logs.read_wal(spark, str(tmp_path / "wal")).collect())
    assert got == [(0, 1, "key_0", "v0", 0.0), (1, 1, "key_1", "", 0.5), (2, 1, "key_2", "v2", 1.0), (3, 2, "key_3", None, 1.5)]


def test_json_stores(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.json").write_text('{"_id": "alice", "age": 3, "deep": {"x": [1, 2]}}')
    (tmp_path / "docs" / "b.json").write_text("{broken")
    assert [r.id for r in stores.read_documents(spark, str(tmp_path / "docs")).collect()] == ["alice"]
    (tmp_path / "g.json").write_text('{"nodes": {"a": {"n": 1}, "b": {}}, "edges": {"a": [{"to": "b", "type": "follows"}]}}')
    nodes, edges = stores.read_graph(spark, str(tmp_path / "g.json"))
    assert {r.id for r in nodes.collect()} == {"a", "b"} and [tuple(r) for r in stores.reverse(edges).collect()] == [("b", "a", "follows")]
    pairs = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "k string, v long")
    stores.write_pairs(pairs, str(tmp_path / "out"), 2)
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "out")).collect())) == [("x", 1), ("x", 3), ("y", 2)]


# The record format --------------------------------------------------------------------------------------------------
USER = {
    1: codec.Schema("User", 1, (codec.Field(1, "id", "INT64", True), codec.Field(2, "name", "STRING", True), codec.Field(3, "email", "STRING"))),
}
USER[2] = codec.Schema("User", 2, (*USER[1].fields, codec.Field(4, "age", "INT32", default=0), codec.Field(5, "tags", "ARRAY", default=[], item="STRING")))
USER[3] = codec.Schema("User", 3, (*USER[1].fields[:2], *USER[2].fields[3:], codec.Field(6, "metadata", "MAP", default={})))
ADDRESS = codec.Schema("Address", 1, tuple(codec.Field(i, n, "STRING") for i, n in enumerate(("street", "city", "zip"), 1)))
USER[4] = codec.Schema("User", 4, (*USER[3].fields, codec.Field(7, "address", "NESTED", item=ADDRESS)))
ALL = {("User", v): s for v, s in USER.items()}


def test_golden_bytes():
    data = codec.encode({"id": 12345, "name": "alice", "email": "alice@example.com"}, USER[1])
    assert data.hex() == "56454e43000100045573657201000000000000303902" + "05616c696365" + "0311616c696365406578616d706c652e636f6d" + "00"


@pytest.mark.parametrize(
    "writer,reader,record,want",
    [
        (1, 2, {"id": 12345, "name": "alice", "email": "a@e.com"}, {"id": 12345, "name": "alice", "email": "a@e.com", "age": 0, "tags": []}),
        (2, 1, {"id": 67890, "name": "bob", "email": "b@e.com", "age": 30, "tags": ["admin", "user"]}, {"id": 67890, "name": "bob", "email": "b@e.com"}),
        (2, 3, {"id": 1, "name": "c", "email": "c@e.com", "age": 25, "tags": []}, {"id": 1, "name": "c", "age": 25, "tags": [], "metadata": {}}),
        (4, 4, {"id": 2, "name": "d", "age": 1, "tags": ["x"], "metadata": {"a": "b"}, "address": {"city": "springfield"}}, {"id": 2, "name": "d", "age": 1, "tags": ["x"], "metadata": {"a": "b"}, "address": {"city": "springfield"}}),
        (3, 1, {"id": 3, "name": "eve", "age": 4, "tags": ["t"], "metadata": {"k": "v"}}, {"id": 3, "name": "eve"}),
    ],
)
def test_versions(writer, reader, record, want):
    assert codec.decode(codec.encode(record, USER[writer]), ALL, USER[reader]) == want


@settings(max_examples=100, deadline=None)
@given(st.integers(-(2**63), 2**63 - 1), st.text(), st.none() | st.integers(-(2**31), 2**31 - 1), st.lists(st.text(), max_size=4), st.dictionaries(st.text(), st.text(), max_size=3))
def test_round_trip(n, name, age, tags, metadata):
    record = {"id": n, "name": name, "tags": tags, "metadata": metadata} | ({} if age is None else {"age": age})
    assert codec.decode(codec.encode(record, USER[3]), ALL) == {"age": 0} | record


@given(st.integers(0, 2**64 - 1))
def test_varints(n):
    assert codec.read_varint(codec.varint(n) + b"x", 0) == (n, len(codec.varint(n)))


def test_bad_records():
    with pytest.raises(ValueError):
        codec.encode({"id": 1}, USER[1])
    with pytest.raises(ValueError):
        codec.decode(b"XXXX", ALL)
    with pytest.raises(ValueError):
        codec.read_varint(b"\x80", 0)


def test_bloom_filter_misses_and_never_loses(spark):
    from lodestream.operators import changelog as cl

    keys = spark.range(30_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    bloom = cl.bloom_filter(keys, 0.01)
    assert bloom.blocks > 1
    assert cl.might_contain(bloom, keys).where("not maybe").count() == 0
    others = spark.range(30_000).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("key"))
    assert cl.might_contain(bloom, others).where("maybe").count() < 900
    nothing = cl.bloom_filter(keys.limit(0), 0.01)
    assert cl.might_contain(nothing, keys.limit(5)).where("maybe").count() == 0


def test_rw_edges_with_very_long_intervals(spark):
    import random

    from lodestream.operators import mvcc

    rng = random.Random(3)
    rows = [(rng.randrange(3), i, s, s + rng.choice([1, 5, 40, 3000, 10**9])) for i in range(120) for s in [rng.randrange(5000)]]
    df = spark.createDataFrame(rows, "key long, txn_id long, start_ts long, commit_ts long")
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and a[2] < b[3] and b[2] < a[3]}
    got = [(r.reader, r.writer) for r in mvcc.rw_edges(df, df, 10).collect()]
    assert set(got) == want and len(got) == len(want)


def test_commit_index_and_sides(spark):
    from lodestream.operators import replication as rp

    entries = spark.createDataFrame([(i, i // 10) for i in range(40)], "idx long, term long")
    match = spark.createDataFrame([("a", 35), ("b", 38), ("c", 10), ("d", 5)], "follower string, idx long")
    assert rp.commit_index(match, entries, 5).first().commit_index == 35
    assert rp.commit_index(match.limit(1), entries, 5).first().commit_index is None
    assert rp.commit_index(match.where("idx < 30"), entries, 5).first().commit_index is None  # not of the current term
    members = spark.createDataFrame([("n", "l", 1), ("n", "l", 2), ("n", "r", 3), ("m", "l", 1), ("m", "r", 1)], "network string, side string, node int")
    assert {(r.network, r.with_quorum, r.split) for r in rp.sides_with_quorum(members).collect()} == {("n", 1, False), ("m", 2, True)}
