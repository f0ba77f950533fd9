import corpus_pipeline as cp
import pytest

from lodestream.llm import decontaminate, jaccard, packing, pii, quality
from lodestream.llm.common import read

SF = "/root/testdata/sf0.001"


def test_every_stage_decides_on_all_that_its_predecessor_kept(spark, tmp_path):
    docs = read(spark, SF, "documents")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(path := f"{tmp_path}/{name}")
        after = spark.read.parquet(path)
        if name == "packing":
            assert {r.doc_id for r in after.collect()} == set(before)
            break
        assert after.columns == columns
        now = {r.doc_id: r for r in after.collect()}
        assert set(now) <= set(before)
        want = expected(spark, name, docs, before)
        assert set(now) == set(want) and {i: r.text for i, r in now.items()} == want
        docs, before = after, now


def expected(spark, name, docs, rows):
    """doc_id -> text that the operator of the stage leaves."""
    if name == "quality":
        keep = {r.doc_id for r in quality.assess(docs, read(spark, SF, "labels")).where("keep").collect()}
        return {i: r.text for i, r in rows.items() if i in keep}
    if name == "near_duplicates":
        from tests.llm.test_jaccard import brute

        return {i: rows[i].text for i, (_, c) in brute([(i, r.text) for i, r in rows.items()]).items() if c == i}
    if name == "decontamination":
        items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
        bad = {i for i, r in rows.items() if any(decontaminate.closest(" ".join(words(t)), " ".join(words(r.text)))[0] <= 0.2 * len(" ".join(words(t))) for _, t in items)}
        return {i: r.text for i, r in rows.items() if i not in bad}
    w = pii.weights()
    return {i: pii.masked(r.text, pii.all_spans(r.text, w)[1]) for i, r in rows.items()}


def words(text):
    import re

    return re.findall(r"[^\W_]+", (text or "").lower())


def test_run(spark):
    got = cp.run(spark, SF).collect()
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_stages_take_odd_rows(spark, name, stage):
    docs = read(spark, SF, "documents").limit(3)
    odd = spark.createDataFrame([(None, None, None, None, None), (900001, "", "en", None, 0), (900002, "one two three four five six", None, "s", 27), (900002, "one two three four five six", None, "s", 27)], docs.schema)
    out = stage(spark, docs.union(odd), SF)
    assert out.count() >= 0 and (name == "packing" or out.columns == docs.columns)
    empty = stage(spark, docs.limit(0), SF)
    assert empty.count() == 0


def test_jaccard_stage_keeps_one_of_each_group(spark):
    rows = [(5, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (9, "other words entirely here now ok")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.jaccard_stage(spark, docs, SF).collect()) == [3, 9]
