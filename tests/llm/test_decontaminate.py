import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.llm import decontaminate as d
from lodestream.llm.common import read

SF = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", min_size=1, max_size=8), st.text("abc ", max_size=14))
def test_closest_substring(pattern, text):
    best = min(distance(pattern, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
    got, start, end = d.closest(pattern, text)
    assert got == best == distance(pattern, text[start:end])


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def edited(rng, text, rate, pool):
    out = []
    for w in text.split():
        roll = rng.random()
        if roll >= rate:
            out.append(w)
        elif roll < rate / 3:
            out.append(rng.choice(pool))
        elif roll < rate * 2 / 3:
            out += [w, rng.choice(pool)]
    return " ".join(out)


@pytest.mark.parametrize("rate,least", [(0.0, 1.0), (0.08, 0.97), (0.15, 0.93)])
def test_recall_of_edited_items(spark, rate, least):
    """Against the exact distance: items with edited words, in long texts of other words."""
    rng = random.Random(3)
    items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    texts = [r.text for r in read(spark, SF, "documents").where("length(text) > 2000").orderBy("doc_id").limit(40).collect()]
    pool = words(texts[0])
    index, rows, truth = d.build(items), [], []
    for k in range(200):
        item = rng.randrange(len(items))
        change = edited(rng, items[item][1], rate, pool)
        base = rng.choice(texts)
        cut = base.find(" ", rng.randrange(len(base) - 200))
        rows.append(f"{base[:cut]} {change}{base[cut:]}")
        if distance(" ".join(words(items[item][1])), " ".join(words(change))) <= int(d.TOLERANCE * len(index.texts[item])):
            truth.append((k, item))
    found = {(m[0], m[1]) for m in d.matches(index, pa.array(rows))}
    assert len(truth) > 100 and np.mean([t in found for t in truth]) >= least


def test_embedding_turns_edits_into_substitutions():
    """Two windows a few edits apart agree at many steps; unrelated ones at hardly any."""
    rng = np.random.default_rng(1)
    agree = []
    for _ in range(200):
        a = rng.integers(1, 2**63, 60).astype(np.uint64)
        b = np.delete(a, rng.integers(5, 40))
        c = rng.integers(1, 2**63, 60).astype(np.uint64)
        factors = rng.integers(0, 2**63, 80, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        seen = []
        for x in (a, b, c):
            out = []
            d.walk(x.astype(np.int64), x, np.zeros(1, np.int64), np.full(1, len(x)), list(range(80)), factors, lambda k, w, s, out=out: (out.append(int(w[0])), (np.arange(1), s))[1])
            seen.append(np.array(out))
        agree.append(((seen[0] == seen[1]).mean(), (seen[0] == seen[2]).mean()))
    near, far = np.mean(agree, 0)
    assert near > 0.5 and far < 0.01


def test_whole_table(spark):
    """Every item that stands in a document word by word is found, and every hit is within the tolerance."""
    docs = {r.doc_id: r.text or "" for r in read(spark, SF, "documents").collect()}
    items = {r.item_id: r.text for r in read(spark, SF, "benchmark").collect()}
    got = d.op4_decontamination(spark, SF).collect()
    plain = {i: f" {' '.join(words(t))} " for i, t in docs.items()}
    exact = {(i, k) for i, t in plain.items() for k, item in items.items() if f" {' '.join(words(item))} " in t}
    assert exact and exact <= {(r.doc_id, r.item_id) for r in got}
    for r in got:
        there, item = " ".join(words(docs[r.doc_id][r.start : r.end])), " ".join(words(items[r.item_id]))
        assert r.distance <= d.TOLERANCE * len(item) and distance(item, there) <= r.distance + 12
        if (r.doc_id, r.item_id) in exact:
            assert r.distance == 0 and there == item


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "ONE two, three four five six seven"), (3, "ONE two, three four five six seven"), (None, "x one two three four five six seven y"), (4, "word " * 100_000 + "one two three four five six seven"), (5, "İ one two three four five six seven")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item_id": F.lit("clash"), "start": F.lit(1)})
    items = spark.createDataFrame([(7, "one two three four five six seven"), (8, None), (9, "!!"), (7, "one two three four five six seven"), (None, "word word word word")], "item_id long, text string")
    got = d.contaminated(docs, items).collect()
    found = sorted((r.doc_id or 0, r.item_id) for r in got if r.item_id == 7)
    assert found == [(0, 7)] * 2 + [(3, 7)] * 4 + [(4, 7)] * 2 + [(5, 7)] * 2
    by = {r.doc_id: r for r in got if r.item_id == 7}
    assert rows[6][1][by[5].start : by[5].end] == "one two three four five six seven" and by[3].start == 0
    assert d.contaminated(docs.limit(0), items).count() == 0 and d.contaminated(docs, items.limit(0)).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    docs, items = read(spark, SF, "documents"), read(spark, SF, "benchmark")
    whole = {(r.doc_id, r.item_id) for r in d.contaminated(docs, items).where("distance = 0").collect()}
    monkeypatch.setattr(d, "BLOCK_CHARS", 3000)
    assert {(r.doc_id, r.item_id) for r in d.contaminated(docs, items).where("distance = 0").collect()} == whole


def test_copy_behind_a_stray_candidate(monkeypatch):
    """The item's opening words stand before its copy: the second start is compared as a whole."""
    rng = random.Random(5)
    pool = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(200)]
    item = pool[:60]
    for gap in (16, 20, 29):
        text = " ".join(item[:20] + pool[60 : 60 + gap] + item + pool[100:200])
        monkeypatch.setattr(d, "candidates", lambda *_, gap=gap: {(0, 0): {0, 20 + gap}})
        hits = d.matches(d.build([(1, " ".join(item))]), pa.array([text]))
        assert [(h[0], h[1], h[4]) for h in hits] == [(0, 0, 0)] and text[hits[0][2] : hits[0][3]] == " ".join(item)


def mistyped(rng, text, edits):
    """The text with edits at different characters: others in their place, gone, or one more behind them."""
    out = list(text)
    for i in rng.sample(range(len(out)), edits):
        roll, letter = rng.random(), rng.choice("abcdefghijklmnopqrstuvwxyz")
        out[i] = letter if roll < 0.6 else "" if roll < 0.8 else out[i] + letter
    return "".join(out)


@pytest.mark.parametrize("share", [0.05, 0.12, 0.2])
def test_recall_of_typos(spark, share):
    """Against the exact distance: typos in characters, up to the whole tolerance."""
    rng = random.Random(7)
    items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    base = [r.text for r in read(spark, SF, "documents").where("length(text) > 1000").orderBy("doc_id").limit(20).collect()]
    index, rows, truth = d.build(items), [], []
    for k in range(200):
        item = k % len(items)
        change = mistyped(rng, index.texts[item], int(share * len(index.texts[item])))
        if distance(index.texts[item], " ".join(words(change))) <= int(d.TOLERANCE * len(index.texts[item])):
            truth.append((len(rows), item))
        rows.append(f"{base[k % 20][:500]} {change} {base[k % 20][500:1000]}")
    found = {(m[0], m[1]) for m in d.matches(index, pa.array(rows))}
    assert len(truth) > 150 and np.mean([t in found for t in truth]) >= 0.97


def test_bound_of_pieces():
    """No more than the exact distance, in windows of any place."""
    rng = random.Random(9)
    items = ["".join(rng.choices("abc ", k=n)).strip() or "a" for n in (1, 5, 63, 64, 65, 150)]
    sp, text = d.spelling(items, 0.2), "".join(rng.choices("abcd", k=900))
    codes = sp.number[d._codes(text)]
    rows = [(i, lo, min(lo + rng.randrange(1, 400), 900)) for i in range(len(items)) for lo in rng.sample(range(900), 20)]
    item, lo, hi = (np.array(x) for x in zip(*rows, strict=True))
    bound = d.least(sp, codes, item, lo, hi)
    exact = np.array([d.closest(items[i], text[a:b])[0] for i, a, b in rows])
    one = np.array([len(items[i]) <= 64 for i in item])
    assert (bound <= exact).all() and (bound == exact)[one].all()


def test_runs_are_looked_for_only_where_one_may_begin():
    """All runs of all lengths are found, to the end of the characters and over the borders of chunks; few places are hashed in full."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 7)))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 3, 8, 20, 60, 120])]
    index = d.build(items)
    noise = lambda n: " ".join(word() for _ in range(n))
    texts = pa.array([f"{noise(9000)} {t} {noise(7)}" for _, t in items] + [t for _, t in items] + ["", "a"])
    w, sp = d.lowered(texts), index.spelling(0.2)
    codes, _ = d.spelled(w, sp.number)
    assert len(codes) > d.CHUNK and len(sp.runs) > 2
    want = set()
    for r in sp.runs:
        h = np.zeros(len(codes) - r.length + 1, np.uint64)
        for k in range(r.length):
            h = h * d.CHARACTER + codes[k : k + len(h)]
        assert (d.rolled(codes.astype(np.uint64), r.length) == h).all()
        key = np.minimum(np.searchsorted(r.hashes, h), len(r.hashes) - 1)
        for at in np.flatnonzero(r.hashes[key] == h).tolist():
            want |= {(int(r.item[x]), at, at - int(r.place[x])) for x in range(r.first[key[at]], r.first[key[at] + 1])}
    assert set(zip(*(x.tolist() for x in d.run_hits(sp, codes)), strict=True)) == want
