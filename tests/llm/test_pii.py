import hashlib
import itertools
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.llm import pii
from lodestream.llm.common import read

SF = "/root/testdata/sf0.01"


def plain(text):
    """The contract's base spans, written down once more."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if max(map(int, m[0].split("."))) <= 255:
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        doubled = [x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d[::-1])]
        if 14 <= len(d) <= 19 and sum(doubled) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return [(s, pii.KINDS[k], e) for s, k, e in sorted(found)]


def test_whole_table(spark):
    texts = {r.doc_id: r.text or "" for r in read(spark, SF, "documents").collect()}
    got = pii.op7_personal_data(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain(texts[r.doc_id])
        line = ",".join(f"{k}:{s}:{e}" for s, k, e in base)
        counts = Counter(k for _, k, _ in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [counts[k] for k in pii.KINDS]
        assert not set(line.split(",")) - set(r.spans.split(","))  # base spans stay


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("a1.@_-+ ()25"), max_size=40))
def test_base_spans_of_any_text(text):
    assert pii.base_spans(text) == plain(text)


def test_field_on_unseen_examples():
    w, right, wrong, missed = pii.weights(), 0, 0, 0
    for text, marks in pii.examples(300, seed=77):
        want = {(s, pii.KINDS[k], e) for s, e, k in marks}
        got = set(pii.field_spans(text, w))
        right, wrong, missed = right + len(want & got), wrong + len(got - want), missed + len(want - got)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.85


def test_decoding_is_the_best_joint_segmentation():
    """Against all ways to choose segments that do not overlap."""
    w = pii.weights()
    for text in ["x 1-784-589-3706 y", "a an@er.com 12", "812 831 4669"]:
        spans = pii.pieces(text, 0, len(text))
        scored = []
        for i, j, a, b in pii.segments(text, spans):
            s = max((float(w[k, pii.features(text, a, b)].sum()), k) for k in range(len(pii.KINDS)))
            if s[0] >= pii.MARGIN:
                scored.append((i, j, s[0], (a, pii.KINDS[s[1]], b)))
        best = (0.0, ())
        for n in range(1, 4):
            for chosen in itertools.combinations(scored, n):
                if all(x[1] <= y[0] or y[1] <= x[0] for x, y in itertools.combinations(chosen, 2)):
                    best = max(best, (sum(x[2] for x in chosen), tuple(sorted(x[3] for x in chosen))))
        assert tuple(pii.field_spans(text, w)) == best[1]


def test_likelihood_gradient_is_fitted():
    w = pii.weights()
    assert w.shape == (4, pii.N_FEATURES) and np.isfinite(w).all()
    number = pii.NUMBER
    assert w[0, number["mail"]] > 0 > w[0, number["no_letters"]] and w[2, number["luhn"]] > w[2, number["no_luhn"]]


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "é\U0001f600 a.b@c.de, 10.0.0.1"), (4, "7 " * 50_000), (4, "7 " * 50_000), (5, "1" * 100_000), (None, "+1 (984) 555-5227"), (6, "0." * 4000 + "1"), (7, "@" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"base": F.lit("clash"), "spans": F.lit(1)})
    got = pii.find_personal_data(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [tuple(x) for x in by[3].base] == [(3, "email", 11), (13, "ip", 21)]
    assert by[1].spans == [] and by[None].base[0].kind == "phone"
    assert pii.find_personal_data(docs.limit(0)).count() == 0
    out = pii.personal_data_stage(spark, docs.withColumn("n_chars", F.length("text").cast("long")), "").collect()
    text = {r.doc_id: r for r in out}
    assert text[3].text == "é\U0001f600 <email>, <ip>" and text[3].n_chars == len(text[3].text) and text[1].text is None


def test_foreign_texts():
    """Lines that the grammar of the examples does not make."""
    w = pii.weights()
    found = lambda t: [(k, t[a:b]) for a, k, b in pii.all_spans(t, w)[1]]
    assert ("phone", "(415) 555-2671") in found("Please call our front desk, (415) 555-2671, before noon.")
    assert ("email", "jane.doe (at) example.org") in found("Reach me: jane.doe (at) example.org")
    for t in ("On 2023-11-05 we sold 12,500 units for $3,400.50.", "See RFC 2822, section 3.4.1.", "Chapter 12 ends on page 304."):
        assert found(t) == [], t


def test_many_numbers_take_linear_time():
    import time

    w, took = pii.weights(), []
    for n in (4000, 16_000):
        text = " ".join(f"10.0.{i % 256}.{i % 199}" for i in range(n))
        began = time.time()
        base, spans = pii.all_spans(text, w)
        took.append(time.time() - began)
        assert len(base) == n and len(spans) >= n
    assert took[1] < 8 * took[0] + 1
