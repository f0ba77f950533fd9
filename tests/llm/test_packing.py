import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.llm import packing as p
from lodestream.llm.common import read


def ids_of(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [x.ids + [p.END] for x in tok.encode_batch(texts, add_special_tokens=False)]


def fewest(sizes, capacity):
    """The optimum, by trying all placements of a few pieces."""
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= capacity and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] + sizes[k], *bins[i + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best


def as_counts(sizes):
    return {s: sizes.count(s) for s in set(sizes)}


@settings(max_examples=300, deadline=None)
@given(st.integers(3, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_every_piece_is_placed_once_and_fits(case):
    capacity, sizes = case
    got = []
    for pattern, n in p.solve(as_counts(sizes), capacity):
        assert pattern and n > 0 and sum(pattern) <= capacity
        got += list(pattern) * n
    assert sorted(got) == sorted(sizes)


def test_reduction_keeps_the_optimum():
    rng = random.Random(7)
    for _ in range(150):
        sizes = sorted((rng.randint(1, 12) for _ in range(rng.randint(1, 8))), reverse=True)
        left = p.Sizes(as_counts(sizes))
        fixed = sum(n for _, n in p.reduce_by_dominance(left, 12))
        rest = sorted((s for s, n in left.counts.items() for _ in range(n)), reverse=True)
        assert fixed + fewest(rest, 12) == fewest(sizes, 12)


def test_whole_table_against_tokenizers(spark, small):
    docs = {r.doc_id: r.text or "" for r in read(spark, small, "documents").collect()}
    rows = p.op3_packing(spark, small).collect()
    check(docs, rows, p.CAPACITY)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= 1.01 * -(-total // p.CAPACITY) + 1


def check(docs, rows, capacity):
    ids = dict(zip(docs, ids_of(list(docs.values())), strict=True))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for doc, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        at = 0
        for k, r in enumerate(parts):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[doc][at : at + r.length], "<u4").tobytes())
            assert k == 0 or r.length == capacity
            at += r.length
        assert at == len(ids[doc]) and (len(parts) == 1 or at > capacity)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity


@pytest.mark.parametrize("with_ids", [False, True])
def test_edges(spark, with_ids):
    rows = [(1, None), (2, ""), (3, "a b c d " * 30), (4, "é世界 \U0001f600 <|endoftext|>"), (5, "x" * 5000), (6, "tie"), (7, "tie")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"length": F.lit("clash"), "piece": F.lit(0.5)})
    got = p.packed(docs, capacity=16, with_ids=with_ids)
    rows_out = got.collect()
    check({i: t or "" for i, t in rows}, rows_out, 16)
    if with_ids:
        assert all(len(r.ids) == r.length for r in rows_out)
    assert p.packed(docs.limit(0)).count() == 0


def test_repeated_rows_are_all_packed(spark):
    docs = spark.createDataFrame([(1, "same text")] * 5 + [(None, "no id")], "doc_id long, text string")
    got = p.packed(docs, capacity=8).collect()
    assert len(got) == 6 and len({(r.sequence_id, r.offset) for r in got}) == 6


def test_added_tokens_have_their_own_ids(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "no such thing <|endof", " <|ENDOFTEXT|>"]
    got = {r.doc_id: r.ids for r in p.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).collect()}
    assert [got[k] for k in range(len(texts))] == ids_of(texts)
    assert 50256 in got[0] and 50256 not in got[3]
