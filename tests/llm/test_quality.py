import numpy as np
from pyspark.sql import functions as F

from lodestream.llm import quality as q
from lodestream.llm.common import read

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = read(spark, SMALL, "documents"), read(spark, SMALL, "labels")
    inside = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) > 0)
    outside = labels.join(inside, "doc_id", "left_anti")
    got = q.assess(docs, inside).join(outside, "doc_id").select("keep", "quality", "toxic").collect()
    right = [r.keep == (r.quality == 1 and r.toxic == 0) for r in got]
    assert len(right) > 60 and np.mean(right) > 0.85


def test_all_documents_in_the_query(spark, small):
    got = q.op9_quality(spark, small).collect()
    assert len(got) == read(spark, small, "documents").count()
    assert all(0 <= x <= 1 for r in got for x in (r.p_quality, r.p_toxic, r.post_quality, r.post_toxic))


def brute(rows):
    """Posteriors of (host, path, p) with the document itself left out of its site, by loops."""
    total, n = sum(p for *_, p in rows), len(rows)
    rate = total / n
    hosts, paths = {}, {}
    for h, q, p in rows:
        hosts.setdefault(h, []).append(p)
        paths.setdefault((h, q), []).append(p)
    mean = lambda x: sum(x) / len(x)
    strength = lambda r, extra: min(max(r * (1 - r) / max(extra, 1e-9) - 1, 1.0), 1e6)
    of_hosts = strength(rate, sum(len(x) * (mean(x) - rate) ** 2 - rate * (1 - rate) for x in hosts.values()) / n)
    several = {k: x for k, x in paths.items() if len([1 for j in paths if j[0] == k[0]]) > 1}
    of_paths = 1e6
    if several:
        own = {k: mean(hosts[k[0]]) for k in several}
        of_paths = strength(rate, sum(len(x) * (mean(x) - own[k]) ** 2 - own[k] * (1 - own[k]) for k, x in several.items()) / sum(map(len, several.values())))
    odds = lambda p: np.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    out = []
    for h, q, p in rows:
        host = (sum(hosts[h]) - p + of_hosts * rate) / (len(hosts[h]) - 1 + of_hosts)
        path = (sum(paths[h, q]) - p + of_paths * host) / (len(paths[h, q]) - 1 + of_paths)
        out.append(1 / (1 + np.exp(-(odds(p) + odds(path) - odds(rate)))))
    return out


def test_posteriors_against_brute_force(spark):
    """Sites move a document over the line, and one document does not make a rate."""
    rows = [("big", "", 0.9)] * 40 + [("low", "a", 0.1)] * 40 + [("low", "b", 0.45)] * 3 + [("low", "c", 0.8)] * 30 + [("one", "", 0.55), ("big", "", 0.45), (None, "", 0.5)]
    table = spark.createDataFrame([(k, h, q, p, 0.1) for k, (h, q, p) in enumerate(rows)], "k long, _host string, _path string, _p_quality double, _p_toxic double")
    found, priors = q.sites(table)
    sums = found.withColumnsRenamed({"_host": "_h", "_path": "_q"})
    joined = table.join(sums, F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_q")))
    got = {r.k: r.post for r in joined.select("k", q._posterior("quality", priors).alias("post")).collect()}
    want = brute(rows)
    assert np.allclose([got[k] for k in range(len(rows))], want)
    by = dict(zip(rows, want, strict=True))
    assert by["big", "", 0.45] > 0.5 and by["low", "b", 0.45] < 0.45  # the same document, at two sites
    assert abs(by["one", "", 0.55] - 0.55) < 0.1
    assert priors.host["quality"] != priors.path["quality"]


def test_sites_change_decisions(spark):
    """Documents of equal evidence are kept or rejected by their sites."""
    good, bad = "clear useful careful words", "spam buy cheap now"
    rows = [(k, good, "fine.org/a") for k in range(40)] + [(100 + k, bad, "spam.biz/x") for k in range(40)]
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, *_ in rows], "doc_id long, quality int, toxic int")
    rows += [(901, "neither of these", "fine.org/a"), (902, "neither of these", "spam.biz/x")]
    got = {r.doc_id: r for r in q.assess(spark.createDataFrame(rows, "doc_id long, text string, source string"), labels).collect()}
    assert got[901].p_quality == got[902].p_quality and got[901].keep and not got[902].keep


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (1, 1, 0), (99, 1, None)], "doc_id long, quality int, toxic int")
    rows = [(1, "fine words here", "s/a/b"), (2, "bad bad bad bad", None), (3, None, "s"), (4, "", "s"), (5, "!!! ???", "t"), (6, "w " * 200_000, "t"), (6, "w " * 200_000, "t"), (None, "no id", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"_p_quality": F.lit("clash"), "keep": F.lit("x"), "_host": F.lit(3), "hashes": F.lit(1)})
    got = q.assess(docs, labels).collect()
    assert len(got) == len(rows)
    assert not any(r.keep for r in got if r.doc_id in (3, 4, 5))
    assert len({(r.keep, r.p_quality) for r in got if r.doc_id == 6}) == 1
    assert q.assess(docs.limit(0), labels).count() == 0
    unlabelled = q.assess(docs, labels.limit(0)).collect()
    assert {r.doc_id for r in unlabelled if r.keep} == {1, 2, 6, None}
    kept = q.quality_stage(spark, read(spark, SMALL, "documents"), SMALL)
    assert kept.columns == read(spark, SMALL, "documents").columns
