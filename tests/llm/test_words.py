import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream.llm import words as w

TEXTS = st.lists(st.text(st.sampled_from("ab Cé\t\n\x1c 世-9"), max_size=30), max_size=6)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    got = w.words(pa.array(texts, pa.string()))
    want = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
    found = [bytes(got.data[a:b]).decode() for a, b in zip(got.starts, got.ends, strict=True)]
    assert [found[got.first[i] : got.first[i + 1]] for i in range(len(texts))] == want
    by_hash = {}
    for x, h in zip(found, got.hashes.tolist(), strict=True):
        assert by_hash.setdefault(h, x) == x
    assert len(by_hash) == len(set(found))


def test_blocks_do_not_change_hashes(monkeypatch):
    texts = pa.array(["one two three " * 50, "", "x" * 5000, "one two"])
    whole = w.words(texts).hashes
    monkeypatch.setattr(w, "BLOCK", 7)
    assert (w.words(texts).hashes == whole).all()
    assert (w.words(texts.slice(2)).hashes == whole[-3:]).all()
