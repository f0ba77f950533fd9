"""License scans by canonical digest.

A text is brought into canonical form (case, copyright lines, punctuation, equivalent spellings, white space and line
breaks) and its SHA-256 is looked up among the digests of known license texts by a hash join. Known are short licenses
and notices by their texts, and long licenses (Apache, GPL, LGPL, MPL and others) by their digests alone; other tables
can be given. Each document is looked up as a whole,
and so is every line of it, since notices such as "Released under the MIT License." stand on lines of their own.
Lines whose canonical length no known text has are left out before they are hashed; no digest of theirs could match.

Defined cases: a null text is empty, and the canonical form of a text without letters and digits is empty and
matches nothing; equal rows give equal results; other columns are ignored; an empty table gives no rows. The table of
known texts is a constant of this module, so its broadcast has a fixed size.
"""

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import read

# License texts and notices as their publishers word them.
MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
KNOWN_TEXTS = [
    ("MIT", MIT_BODY), ("MIT", "MIT License\n" + MIT_BODY), ("MIT", "The MIT License (MIT)\n" + MIT_BODY),
    ("ISC", ISC_BODY), ("ISC", "ISC License\n" + ISC_BODY),
    ("BSD-2-Clause", BSD_CLAUSES + BSD_END), ("BSD-2-Clause", "BSD 2-Clause License\n" + BSD_CLAUSES + BSD_END),
    ("BSD-3-Clause", BSD_CLAUSES + BSD_THIRD + BSD_END), ("BSD-3-Clause", "BSD 3-Clause License\n" + BSD_CLAUSES + BSD_THIRD + BSD_END),
    ("BSL-1.0", BOOST), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n" + BOOST),
    ("Zlib", ZLIB), ("Zlib", "zlib License\n" + ZLIB),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
]
#: Digests (and lengths) of the canonical form of whole licenses, as Debian's common-licenses hold them.
WHOLE_LICENSES: list[tuple[str, str, int]] = [
    ("Apache-2.0", "9e4026e00d216f53b9e991919c21cb2e38ef09f9af4f89e01dddf32c9141f41f", 9885),
    ("Artistic-1.0-Perl", "d204941775ec7bcd689de0a18b9e348b6828c2e6004b77bab8baf847cd70cee5", 5824),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", 6692),
    ("GFDL-1.2", "737af0c3e21ac391f5e234493ea6103365e5833ad67bb5ad28a44b9b43f3f144", 19582),
    ("GFDL-1.3", "40049fc930c88afc3527ec5234861781e1d4693b5cddc5310929bc6182799ffd", 22012),
    ("GPL-1.0", "0d4d6bb171d3425335326f950fa50d55086d8b01637e20e06af1e3f5070a8576", 11762),
    ("GPL-2.0", "7746ae1455f20704915f25e13072aaec37db9e477f924a0abf7b10d0e2485d8e", 17113),
    ("GPL-3.0", "7dc350914edcbb4d297cfe01069bb780fd0171b68b891986b2141226c9a6d447", 33396),
    ("LGPL-2.0", "23e12ed36e9072a47560178018a162b3f752de2dd24b1709a19c2ea8bb45a596", 24127),
    ("LGPL-2.1", "0ea5e0b8b97c23dd3c5e2e6dcf61b17095dc2913cd88a62342a5723b642d2046", 25211),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", 7104),
    ("MPL-1.1", "31670241c91330ba91feb5aea53cfc9fa4434ed80dc67b9d5cc0783288541f69", 22470),
    ("MPL-2.0", "0c0e48da106b389986ac108e2ee0ad1c64670b63f2fbe0703edcbaedb049daa8", 14343),
]
#: Spellings that count as the same. Each is a single word without punctuation, so line breaks do not matter.
EQUIVALENT = [
    ("licence", "license"), ("sublicense", "sub license"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("behaviour", "behavior"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"), ("favour", "favor"), ("fulfill", "fulfil"), ("holder", "owner"), ("initialise", "initialize"), ("judgement", "judgment"), ("labour", "labor"), ("modelled", "modeled"), ("noncommercial", "non commercial"), ("noninfringement", "non infringement"), ("organisation", "organization"), ("percent", "per cent"), ("programme", "program"), ("recognise", "recognize"), ("utilisation", "utilization"), ("while", "whilst"), ("wilful", "willful"),
]
#: A line that says whose the copyright is: with a sign, a year or a place for one, or "by". A line of a wrapped license
#: that merely begins with the word is none.
COPYRIGHT_LINE = r"(?m)^[ \t/*#;-]*(copyright[ \t]*(\(c\)|©)|copyright[ \t]+([0-9]{4}|by[ \t]|[<\[{](year|yyyy))|\(c\)[ \t]*(copyright|[0-9]{4})|©|all rights reserved[.]?[ \t]*$)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """The text in canonical form, line by line: lines still stand apart, with blanks around what is left of them."""
    text = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, ""), NOT_WORD, " ")
    for a, b in EQUIVALENT:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def canonical(text: str) -> str:
    """The same for one Python string as a whole."""
    text = re.sub(r"[^\w]+|_", " ", re.sub(COPYRIGHT_LINE, "", text.lower()))
    for a, b in EQUIVALENT:
        text = text.replace(a, b)
    return " ".join(text.split())


def known(texts: list[tuple[str, str]] | None = None, digests: list[tuple[str, str, int]] | None = None) -> dict[str, tuple[str, int]]:
    """Digest -> (license, length of the canonical text). Two licenses with one digest are an error."""
    rows = list(WHOLE_LICENSES if digests is None else digests)
    for name, t in KNOWN_TEXTS if texts is None else texts:
        c = canonical(t)
        rows.append((name, hashlib.sha256(c.encode()).hexdigest(), len(c)))
    out: dict[str, tuple[str, int]] = {}
    for name, digest, n in rows:
        if out.setdefault(digest, (name, n))[0] != name:
            raise ValueError(f"{name} and {out[digest][0]} have the same canonical text")
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """Per document a row with unit 0, its digest and its license or null; and per line that is a known text a row
    with the line's number, from 1. ``table``: what ``known`` makes of other texts and digests; a few thousand at most."""
    spark = docs.sparkSession
    table = known() if table is None else table
    digests = spark.createDataFrame([(d, n) for d, (n, _) in table.items()], "digest string, license string")
    lengths = sorted({n for _, n in table.values()})
    lines = docs.select(F.col(id_col).alias("doc_id"), canonical_lines(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    whole = F.trim(F.regexp_replace("text", "[ \n]+", " "))
    units = F.filter(
        F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("unit"), F.trim(x).alias("body"))),
        lambda u: F.length(u.body).isin(lengths),
    )
    found = lines.select("doc_id", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("unit"), whole.alias("body"))), units)).alias("u"))
    found = found.select("doc_id", F.col("u.unit").alias("unit"), F.sha2(F.col("u.body").cast("binary"), 256).alias("digest"))
    return found.join(F.broadcast(digests), "digest", "left").where("unit = 0 or license is not null").select("doc_id", "unit", "digest", "license")


def op10_license_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of all documents and of their lines."""
    return scan(read(spark, sf_dir, "documents"))


def _sql() -> str:
    text = rf"regexp_replace(regexp_replace(lower(coalesce(text, '')), '{COPYRIGHT_LINE}', '', 'g'), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    for a, b in EQUIVALENT:
        text = f"replace({text}, '{a}', '{b}')"
    values = ", ".join(f"('{d}', '{n}')" for d, (n, _) in known().items())
    return rf"""
WITH known(digest, license) AS (VALUES {values}),
c AS (SELECT doc_id, {text} AS text FROM documents),
l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM c),
u AS (SELECT doc_id, 0 AS unit, trim(regexp_replace(text, '[ \n]+', ' ', 'g')) AS body FROM c
      UNION ALL SELECT doc_id, unnest(range(1, len(lines) + 1))::INT AS unit, trim(unnest(lines)) AS body FROM l)
SELECT doc_id, unit, sha256(body) AS digest, license FROM u LEFT JOIN known ON sha256(body) = known.digest
WHERE unit = 0 OR license IS NOT NULL"""


QUERIES = {"op10_license_lookup": op10_license_lookup}
ORACLES = {"op10_license_lookup": _sql()}
