import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestream.llm import langid as lid
from lodestream.llm.common import read

SF = "/root/testdata/sf0.01"


def plain(text):
    out = []
    for c in text.lower():
        c = c if c.isalpha() else " "
        if not (c == " " and (not out or out[-1] == " ")):
            out.append(c)
    return "".join(out)


def sequences(text):
    t = " " * (lid.ORDER - 1) + plain(text).lstrip(" ")
    t = t if t.endswith(" ") else t + " "
    return [x for x in (t[i : i + lid.ORDER] for i in range(len(t) - lid.ORDER + 1)) if not x.isspace()]


def brute(table, lang, gram):
    """Interpolated Kneser-Ney probability of a sequence's last character from the counts of one language."""
    orders, now = [], Counter({g: c for (la, g), c in table.items() if la == lang})
    for _ in range(lid.ORDER):
        orders.append(now)
        now = Counter(g[1:] for g in now)
    size = len({g[-1] for _, g in table}) + 1
    p = 1 / size
    for counts, n in zip(reversed(orders), range(1, lid.ORDER + 1), strict=True):
        once, twice = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
        d = min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.95)
        tail = gram[-n:]
        total = sum(c for g, c in counts.items() if g[:-1] == tail[:-1])
        if total:
            kinds = sum(g[:-1] == tail[:-1] for g in counts)
            p = max(counts[tail] - d, 0) / total + d * kinds / total * p
    return p


def built(spark, rows, **more):
    return lid.build(spark.createDataFrame(sorted(rows), "lang string, gram string, n long"), **more)


def test_model_is_interpolated_kneser_ney(spark):
    texts, langs = ["the cat sat on the mat", "a cat, the hat!", "le chat est la"], ["en", "en", "fr"]
    rows = lid.counted(pa.array(texts), langs)
    assert Counter({(la, g): c for la, g, c in rows}) == Counter((la, g) for t, la in zip(texts, langs, strict=True) for g in sequences(t))
    table = {(la, g): c for la, g, c in rows}
    model = built(spark, rows)
    assert len(model.shards) == 1
    for gram in ["the ", " cat", "zzzz", "  ch", "t es", "xthe"]:
        got = np.exp(model.shards[0].value.log_shares(np.array([[ord(c) for c in gram]], np.uint32)))[0]
        assert np.allclose(got, [brute(table, la, gram) for la in ("en", "fr")]), gram


@pytest.mark.parametrize("shard_rows", [10**6, 20])
def test_entropy_of_a_text(spark, shard_rows):
    rows = lid.counted(pa.array(["the cat sat", "le chat est"]), ["en", "fr"])
    model = built(spark, rows, shard_rows=shard_rows)
    assert (len(model.shards) > 3) == (shard_rows == 20)
    for text in ["the chat", "  x", "cat"]:
        seq = sequences(text)
        entropy = [-sum(math.log(brute({(la, g): c for la, g, c in rows}, lang, s)) for s in seq[: len(plain(text).strip())]) for lang in model.langs]
        docs = spark.createDataFrame([(0, ""), (1, "noise"), (2, text)], "doc_id long, text string")
        found = {r.doc_id: r for r in lid.entropies(docs, model, ["doc_id"]).collect()}
        assert np.allclose(found[2]["_entropy"], np.array(entropy) / found[2]["_length"], rtol=1e-4) and not found[0]["_some"]
        said = {r.doc_id: r for r in lid.identify(docs, model).collect()}
        assert said[2].lang_pred == model.langs[int(np.argmin(entropy))] and said[0].lang_pred == "und" and said[0].score == 0


def test_ties_go_to_the_smaller_name(spark):
    docs = spark.createDataFrame([(1, "same words here", "b"), (2, "same words here", "a")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in lid.identify(docs, lid.train(docs)).collect()} == {"a"}


def test_rare_sequences_and_small_languages_stay(spark):
    """Nothing is left out, however many sequences the others have."""
    rows = [(k, " ".join(chr(0x4E00 + (k * 37 + j * 11) % 3000) for j in range(60)), "zh") for k in range(60)] + [(1000, "zmrzlina a kolotoc", "cs")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lid.train(docs, shard_rows=500)
    got = {r.doc_id: r.lang_pred for r in lid.identify(docs, model).collect()}
    assert got == {k: la for k, _, la in rows} and len(model.shards) > 5


def test_few_learned_texts_are_rejected(spark):
    docs = read(spark, SF, "documents")
    got = lid.identify(docs, lid.train(docs)).where("lang_pred <> 'und'").agg(F.avg(F.col("rejected").cast("int"))).first()[0]
    assert got < 0.05


def test_limits_come_from_all_learned_texts(spark):
    """The band's mean and deviation are those of every learned text, in train() and in the query."""
    docs = read(spark, SF, "documents").where("text is not null and lang is not null").where(~lid.held_out())
    model = lid.train(docs)
    seen = {}
    for r in lid.entropies(docs, model, ["lang"]).where("_some").collect():
        seen.setdefault((r.lang, int(lid.band_of(np.array([r["_length"]]))[0])), []).append(r["_entropy"][model.langs.index(r.lang)])
    full = [(k, e) for k, e in seen.items() if len(e) >= lid.LEAST_IN_BAND]
    assert len(full) > 4
    for (lang, band), e in full:
        uniform = -np.log(model.shards[0].value.uniform)
        assert np.isclose(model.limits[model.langs.index(lang), band], min(uniform, np.mean(e) + lid.WIDTH * np.std(e)))
    said, plain = ({r.doc_id: (r.lang_pred, r.score, r.rejected) for r in df.collect()} for df in (lid.op6_language(spark, SF), lid.identify(read(spark, SF, "documents"), model)))
    assert said == plain


def test_held_out_accuracy(spark):
    docs = read(spark, SF, "documents")
    got = lid.op6_language(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98


def test_edges(spark):
    rows = [(1, "hello there my friend", "en"), (2, "bonjour mon ami à la mer", "fr"), (3, None, "en"), (4, "123 !!!", "fr"), (5, "", None), (6, "hello hello " * 20_000, None), (6, "hello hello " * 20_000, None), (None, "世界 \U0001f600", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"gram": F.lit(1), "score": F.lit("clash"), "n": F.lit(2)})
    model = lid.train(docs)
    got = lid.identify(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].lang_pred == "en" and by[2].lang_pred == "fr" and by[6].lang_pred == "en"
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (3, 4, 5))
    assert by[None].lang_pred in ("en", "fr") and by[None].rejected
    assert lid.identify(docs.limit(0), model).count() == 0
    nothing = lid.train(docs.limit(0))
    assert {r.lang_pred for r in lid.identify(docs, nothing).collect()} == {"und"}
