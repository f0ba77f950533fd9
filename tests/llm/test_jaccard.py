import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestream.llm import components as components_module
from lodestream.llm import jaccard as j
from lodestream.llm.common import read
from lodestream.llm.components import components, merged


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, percent=80):
    """doc_id -> (set size, smallest linked doc_id) by comparing all pairs that share anything."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for d, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(d)
    for d, s in sets.items():
        for other, n in Counter(o for g in s for o in holders[g] if o < d).items():
            if 100 * n >= percent * (len(s) + len(sets[other]) - n):
                a, b = sorted((root(d), root(other)))
                parent[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_whole_table(spark, small):
    rows = [(r.doc_id, r.text) for r in read(spark, small, "documents").collect()]
    assert found(j.op5_jaccard(spark, small)) == brute(rows)


def corpus(seed, n=220):
    """Texts around the threshold: chains of edits, shared passages, copies, short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(3)]
    base = [" ".join(word() for _ in range(rng.choice([3, 5, 6, 9, 40, 120]))) for _ in range(25)]
    rows = []
    for d in range(n):
        w = rng.choice(base).split() if rng.random() < 0.7 else [word() for _ in range(rng.randint(1, 60))]
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            w[rng.randrange(len(w))] = word()
        text = " ".join(w)
        rows.append((d * 3 + 1, text if rng.random() < 0.8 else f"{text}\n{rng.choice(passages)}"))
        base += [text] * (rng.random() < 0.3)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_at_the_threshold(spark, seed, monkeypatch):
    if seed == 3:  # lists of the same least node in parts
        monkeypatch.setattr(j, "PART_ROWS", 2)
    if seed == 2:  # long lists in blocks, no broadcasts
        monkeypatch.setattr(j, "BLOCK_ROWS", 4)
        monkeypatch.setattr(j, "SAMPLED", 2)
        monkeypatch.setattr(j, "HOT", 3)
        monkeypatch.setattr(j, "MOST_BROADCAST", 0)
    rows = corpus(seed)
    want = brute(rows)
    assert len({c for _, c in want.values()}) < 0.9 * len(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(j.similarity_classes(docs)) == want


def test_edges(spark):
    rows = [(9, None), (8, ""), (7, " \n "), (6, "A b"), (5, "a  B"), (4, "x y z " * 30_000), (3, "x y z " * 30_001), (3, "x y z " * 30_001), (None, "a b"), (None, "alone in here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit("clash"), "n": F.lit(0), "token": F.lit(1)})
    got = j.similarity_classes(docs).collect()
    assert sorted(((r.doc_id or -1, r.n_shingles, r.component_id) for r in got), key=str) == sorted([(9, 0, 9), (8, 0, 8), (7, 0, 7), (6, 1, 5), (5, 1, 5), (4, 3, 3), (3, 3, 3), (3, 3, 3), (-1, 1, 5), (-1, 1, None)], key=str)
    assert j.similarity_classes(docs.limit(0)).count() == 0
    kept = j.jaccard_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 5, 7, 8, 9]


def test_stage_tells_rows_without_own_ids_apart(spark):
    long = [f"w{k}" for k in range(60)]
    text, near, other = " ".join(long), " ".join([*long, "end"]), " ".join(reversed(long))
    rows = [(None, text), (None, near), (None, text), (7, other), (7, "some words"), (3, "some words"), (9, other), (None, None), (None, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in j.jaccard_stage(spark, docs, "").collect()]
    assert len([t for d, t in got if d is None and t]) == 1
    assert sorted(x for x in got if x[0] is not None) == [(3, "some words"), (7, ""), (7, other)]
    assert got.count((None, None)) == 2


def test_a_large_group_of_near_copies_that_are_not_linked(spark):
    """All share three quarters of their words with all others, and a few pairs are linked."""
    rng = random.Random(9)
    common = [f"c{k}" for k in range(120)]
    rows = [(d, " ".join([*common, *(f"x{rng.randrange(10**6)}" for _ in range(36))])) for d in range(300)]
    rows += [(1000 + d, rows[d][1] + " end") for d in range(0, 300, 50)]
    got = found(j.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert got == brute(rows) and len({c for _, c in got.values()}) == 300


@pytest.mark.parametrize("percent", [50, 90])
def test_other_thresholds(spark, percent):
    rows = corpus(4, 120) + [(9001, "a b c d e f"), (9002, "x a b c d e f"), (9003, "b c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(j.similarity_classes(docs, percent=percent)) == brute(rows, percent)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(50):
        s, t = (np.unique(rng.integers(0, 3000, rng.integers(1, 2000)).astype(np.uint64) << np.uint64(20)) for _ in range(2))
        x, y = (np.frombuffer(j.sketch(z), np.uint8) for z in (s, t))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(s, t))


def test_prefixes_share_enough_under_every_order():
    rng = np.random.default_rng(5)
    seen = 0
    for _ in range(2000):
        s = np.unique(rng.integers(0, 500, rng.integers(5, 200)).astype(np.uint64))
        t = np.unique(np.concatenate((rng.permutation(s)[: int(len(s) * rng.uniform(0.8, 1))], rng.integers(0, 500, rng.integers(0, 20)).astype(np.uint64))))
        both = len(np.intersect1d(s, t))
        if 100 * both >= 80 * (len(s) + len(t) - both):
            seen += 1
            for order in range(3):
                assert len(np.intersect1d(j.prefix(s, order), j.prefix(t, order))) >= j.spare(min(len(s), len(t)))
            for x, y in ((s, t), (t, s)):
                assert -(-len(x) * 80 // 100) // 10 + 1 <= j.spare(len(y))
    assert seen > 200


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (20, 20)] + [(k, k + 1) for k in range(100, 140)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1} | dict.fromkeys(range(5, 10), 5) | dict.fromkeys(range(100, 141), 100)


def test_short_texts_and_shingles():
    sets = j.shingle_sets(pa.array(["a b c d e f", "A B C D E F", "a b", "", "b a", "a b c d e"]))
    assert [len(s) for s in sets] == [2, 2, 1, 0, 1, 1]
    assert (sets[0] == sets[1]).all() and sets[2][0] != sets[4][0] and sets[5][0] in sets[0]


def test_work_on_a_group_of_linked_near_copies_does_not_grow_with_its_square(spark, monkeypatch):
    """Pairs that are compared, and links that are walked, for a group of which no two share all edits."""
    rng = random.Random(7)
    sizes = {}
    for m, names in ((j, ("pairs",)), (components_module, ("links",))):

        def watched(df, name, small=False, to=m.written, names=names):
            out = to(df, name, small)
            if name in names:
                sizes.setdefault(name, []).append(out.count())
            return out

        monkeypatch.setattr(m, "written", watched)
    rows = []
    for d in range(500):
        words = [f"b{k}" for k in range(150)]
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**7)}"
        rows.append((d, " ".join(words)))
    got = found(j.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert got == brute(rows)
    assert max(sizes["pairs"]) <= 2 * j.NEAREST * len(rows)
    assert sum(sizes["links"]) <= 2 * j.NEAREST * len(rows)  # of all rounds


def test_merged_labels_are_those_of_all_links_together(spark):
    rng = random.Random(3)
    node = lambda: rng.randrange(-60, 60)
    for n, more in ((60, 40), (0, 30), (30, 0), (90, 90)):
        first, then = ([(node(), node()) for _ in range(k)] for k in (n, more))
        frame = lambda links: spark.createDataFrame(links, "a long, b long")
        got = {r.node: r.label for r in merged(components(frame(first)), frame(then)).collect()}
        assert got == {r.node: r.label for r in components(frame(first + then)).collect()}
        near = {}
        for a, b in first + then:
            near.setdefault(a, {a}).add(b)
            near.setdefault(b, {b}).add(a)
        for v, label in got.items():
            seen, todo = {v}, [v]
            while todo:
                new = near[todo.pop()] - seen
                seen |= new
                todo += new
            assert label == min(seen)
        assert set(got) == {v for link in first + then if link[0] != link[1] for v in link}


@pytest.mark.parametrize("split", [False, True])
def test_a_node_of_a_large_group_brings_its_sketch_to_two_tasks_at_most_before_the_exact_step(spark, monkeypatch, split):
    """To two for each least node of its lists, however many parts these have, and whether or not some are in blocks."""
    monkeypatch.setattr(j, "PART_ROWS", 500)
    if split:
        monkeypatch.setattr(j, "BLOCK_ROWS", 50)
        monkeypatch.setattr(j, "SAMPLED", 2)
        monkeypatch.setattr(j, "HOT", 60)
    seen, candidates = [], j._candidates

    def watched(rows, percent, near):
        if near:
            brought = rows.where("sketch is not null").groupBy("node").count()
            seen.append(brought.agg(F.sum("count"), F.max("count")).first())
        return candidates(rows, percent, near)

    monkeypatch.setattr(j, "_candidates", watched)
    rng = random.Random(7)
    rows = []
    for d in range(300):
        words = [f"b{k}" for k in range(150)]
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**7)}"
        rows.append((d, " ".join(words)))
    got = found(j.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert got == brute(rows)
    assert len(seen) == j.ORDERS and max(total for total, _ in seen) <= 4 * len(rows)
