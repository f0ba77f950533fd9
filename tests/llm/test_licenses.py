import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestream.llm import licenses as lic


def test_texts_and_lines(spark):
    changed = "The MIT Licence (MIT)\n\nCopyright (c) 2020 Someone\n\n" + lic.MIT_BODY.upper().replace("NONINFRINGEMENT", "NON-INFRINGEMENT").replace(",", " ,")
    rows = [(1, changed), (2, "prose\nreleased under the MIT licence\nmore\nReleased under the MIT License."), (3, None), (4, ""), (5, lic.MIT_BODY + " And one more clause."), (6, "© 2020 only a copyright line"), (7, "w " * 100_000), (7, "w " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"unit": F.lit(1), "license": F.lit("clash"), "digest": F.lit("x")})
    got = lic.scan(docs).collect()
    assert len([r for r in got if r.unit == 0]) == len(rows)
    found = {(r.doc_id, r.unit, r.license) for r in got if r.license}
    assert found == {(1, 0, "MIT"), (2, 2, "MIT"), (2, 4, "MIT")}
    assert lic.scan(docs.limit(0)).count() == 0


def test_python_and_spark_agree(spark):
    rows = [(i, t) for i, (_, t) in enumerate(lic.KNOWN_TEXTS)]
    got = {r.doc_id: r.license for r in lic.scan(spark.createDataFrame(rows, "doc_id int, text string")).where("unit = 0").collect()}
    assert got == {i: name for i, (name, _) in enumerate(lic.KNOWN_TEXTS)}


def test_every_wrapping_is_found(spark):
    """Known texts, wrapped at every width and with a copyright line of someone, are found as what they are."""
    rows, want = [], {}
    for name, text in lic.KNOWN_TEXTS:
        if len(text) < 200:
            continue
        for width in range(40, 121):
            wrapped = "\n".join(textwrap.fill(x, width) for x in text.split("\n"))
            want[len(rows)] = name
            rows.append((len(rows), f"Copyright (c) 2021 Someone\n{wrapped}\n"))
    got = {r.doc_id: r.license for r in lic.scan(spark.createDataFrame(rows, "doc_id int, text string")).where("unit = 0").collect()}
    assert got == want


@pytest.mark.parametrize("name", ["Apache-2.0", "GPL-3", "LGPL-2.1", "MPL-2.0"])
def test_whole_licenses(spark, name):
    file = Path("/usr/share/common-licenses", name)
    if not file.exists():
        pytest.skip("no such file on this machine")
    text = file.read_text()
    joined = " ".join(x for x in text.split())
    rows = [(1, text), (2, text.upper()), (3, text.replace("\n", "\r\n")), (4, text + " and more")]
    got = {r.doc_id: r.license for r in lic.scan(spark.createDataFrame(rows, "doc_id int, text string")).where("unit = 0").collect()}
    assert got[1] == got[2] == got[3] and got[1].startswith(name) and got[4] is None and joined


def test_lines_that_say_whose_it_is():
    body = "one two"
    for line in ("Copyright (c) 2020 A", "copyright 2020 A", "(c) 2020 A", "\u00a9 A", " * Copyright \u00a9 A", "All rights reserved.", "Copyright by A", "Copyright <YEAR> <OWNER>", "Copyright [yyyy] A"):
        assert lic.canonical(f"{line}\n{body}") == body, line
    for line in ("copyright holders be liable", "COPYRIGHT\nOWNER", "copyright notice"):
        assert lic.canonical(f"{line}\n{body}") != body


def test_two_names_for_one_text():
    with pytest.raises(ValueError):
        lic.known([("A", "same text"), ("B", "Same, text!")], [])
    assert list(lic.known([("A", "same text"), ("A", "Same, text!")], []).values()) == [("A", 9)]


def test_own_table(spark):
    docs = spark.createDataFrame([(1, "My own\nlicence!")], "doc_id int, text string")
    assert lic.scan(docs, table=lic.known([("Own", "my own license")], [])).first().license == "Own"
