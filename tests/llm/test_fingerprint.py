import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodestream.llm import fingerprint as fp
from lodestream.llm.common import read


def select(hashes, window=fp.WINDOW):
    """Winnowing as published: the rightmost minimum of every window of consecutive hashes."""
    if not hashes:
        return []
    found = []
    for i in range(max(len(hashes) - window + 1, 1)):
        part = hashes[i : i + window]
        at = i + max(j for j, h in enumerate(part) if h == min(part))
        if (hashes[at], at) not in found:
            found.append((hashes[at], at))
    return found


def grams(spark, text):
    words = re.findall(rf"\S{{1,{fp.PIECE}}}", text.lower(), re.ASCII)
    if not words:
        return []
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").select("i", F.pmod(F.xxhash64("w"), F.lit(fp.PRIME)).alias("h")).orderBy("i").collect()
    h = [r.h for r in rows]
    out = []
    for i in range(max(len(h) - fp.GRAM + 1, 1)):
        v = h[i]
        for x in h[i + 1 : i + fp.GRAM]:
            v = (v * fp.BASE + x) % fp.PRIME
        out.append(v)
    return out


@pytest.mark.parametrize("text", ["", "   ", "one", "one two", "a b c", "x " * 40, "The quick brown fox jumps over the lazy dog again and again", "é" * 50, "a b a b a b a b a b a b"])
def test_winnowing_is_the_rightmost_minimum(spark, text):
    packed = fp.fingerprints(spark.createDataFrame([(text,)], "text string"), "text", "f").first().f
    assert [(x >> 32, fp.LOW - (x & fp.LOW)) for x in packed] == select(grams(spark, text))


def brute(rows):
    """(n_chars, edited text) by doc_id."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: r[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        after, cut = rows[(k + 1) % len(rows)][1], len(t) // 4
        out[i] = (len(t), t[: len(t) - cut] + after[:cut])
    return out


def test_edited_texts_of_the_whole_table(spark, small):
    docs = read(spark, small, "documents")
    want = brute((r.doc_id, r.text) for r in docs.collect())
    got = fp.op1_fingerprints(spark, small).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == {i: (n, hashlib.sha256(e.encode()).hexdigest()) for i, (n, e) in want.items()}
    assert len(got) == len(want)
    long = [r for r in got if r.n_chars > 400]
    assert sum(r.near_edited for r in long) / len(long) > 0.45
    assert sorted(r.near_next for r in long)[len(long) // 2] < 0.05


def test_edges(spark):
    rows = [(5, None), (1, "same words here in both of them"), (3, ""), (9, "same words here in both of them"), (7, "x" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key", F.lit("clash")).withColumn("fp", F.lit(1))
    got = {r.doc_id: r for r in fp.compared(docs).collect()}
    want = brute(rows)
    assert {i: (r.n_chars, r.edited) for i, r in got.items()} == want
    assert got[1].fp == got[9].fp and got[3].fp == got[5].fp == []
    assert got[9].near_next == 1.0 and got[3].near_next == 1.0  # 9 is followed by 1, 3 by the empty 5
    assert fp.compared(docs.limit(0)).count() == 0
    alone = fp.compared(docs.where("doc_id = 1")).first()
    assert alone.near_next == 1.0


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g h"), (2, "z z z z"), (2, "z z z z"), (2, "y y y y")], "doc_id long, text string")
    assert fp.compared(docs).count() == 4
