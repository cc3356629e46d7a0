"""License scans against a plain version, and on real wordings."""

import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.llm import licenses, queries

TEXTS = dict(licenses.texts())


def plain_terms(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return Counter(t for t in re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", text) if t not in licenses.STOP)


class Plain:
    def __init__(self, templates):
        self.counts = [(k, plain_terms(t)) for k, t in templates]
        self.df = Counter(t for _, c in self.counts for t in c)

    def vector(self, counts):
        n = len(self.counts)
        return {t: (1 + math.log(m)) * (math.log((1 + n) / (1 + self.df[t])) + 1) for t, m in counts.items()}

    def best(self, text):
        u = self.vector(plain_terms(text))
        size = math.sqrt(sum(x * x for x in u.values()))
        scores = []
        for k, c in self.counts:
            v = self.vector(c)
            dot = sum(u[t] * v[t] for t in u if t in v)
            scores.append((-round(dot / size / math.sqrt(sum(x * x for x in v.values())), 9) if size else 0, k))
        return min(scores)


def plain_scan(files):
    """doc -> (license, via, found_in, score) over (doc, path, text)."""
    notices, texts, own = Plain(licenses.notices()), Plain(licenses.texts()), {}
    is_file = {d: bool(p and re.search(r"(?i)(^|/)((un)?licen[cs]e|copying|notice)([.-][^/]*)?$", p)) for d, p, _ in files}
    for d, _, text in files:
        found = []
        text = text or ""
        units = [*enumerate(text.split("\n"))]
        units += [(10**9 + i, b.strip(" \t\r\n")) for i, b in enumerate(re.split(r"\n[ \t\r\n]*\n", text)) if "\n" in b.strip(" \t\r\n")]
        for at, body in units:
            s, k = notices.best(body)
            if -s >= 0.6:
                found.append((k == "Proprietary", s, at, k))
        if is_file[d]:
            s, k = texts.best(text)
            if -s >= 0.75:
                found.append((False, s, -1, k))
        if found:
            own[d] = min(found)
    folder = {d: None if p is None else p.rpartition("/")[0] for d, p, _ in files}
    granted = {}
    for d, p, _ in files:
        if is_file[d] and d in own:
            granted.setdefault(folder[d], []).append((own[d][1], p, own[d][3]))
    out = {}
    for d, _, _ in files:
        if d in own:
            out[d] = (own[d][3], "file" if is_file[d] else "header", folder[d], -own[d][1])
            continue
        out[d] = (None, None, None, None)
        up = folder[d]
        while up is not None:
            if up in granted:
                s, _, k = min(granted[up])
                out[d] = (k, "inherited", up, -s)
                break
            up = None if not up else up.rpartition("/")[0]
    return out


def scanned(spark, files):
    df = spark.createDataFrame(files, "doc_id long, path string, text string").withColumn("score", F.lit("clashing")).withColumn("line", F.lit(1))
    return {r["doc_id"]: (r["license"], r["via"], r["found_in"], r["score"]) for r in licenses.scan(df).collect()}


def comment(text, mark="# "):
    return "\n".join((mark + x).rstrip() for x in text.strip().split("\n")) + "\n\ncode(1)\n"


NAMED = "Copyright (c) 2021, Jane Roe <jane@example.org>\nAll rights reserved.\n\n"
GPL_HEADER = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
APACHE_HEADER = """Copyright 2020 The Authors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""
WANTED = [
    ("a/LICENSE", NAMED + TEXTS["BSD-3-Clause"].split("\n\n", 2)[2], "BSD-3-Clause"),
    ("b/LICENSE.txt", NAMED + TEXTS["MIT"].split("\n\n", 2)[2], "MIT"),
    ("c/COPYING", TEXTS["GPL-3.0"], "GPL-3.0"),
    ("d/COPYING", TEXTS["GPL-2.0"], "GPL-2.0"),
    ("e/COPYING.LESSER", TEXTS["LGPL-3.0"], "LGPL-3.0"),
    ("f/LICENSE-APACHE", TEXTS["Apache-2.0"], "Apache-2.0"),
    ("g/LICENSE.md", TEXTS["MPL-2.0"], "MPL-2.0"),
    ("h/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n", "GPL-3.0"),
    ("i/UNLICENSE", TEXTS["Unlicense"], "Unlicense"),
    ("j/LICENCE", TEXTS["AGPL-3.0"], "AGPL-3.0"),
    ("k/x.py", comment(GPL_HEADER), "GPL-3.0"),
    ("k/y.c", "/*\n" + comment(APACHE_HEADER, " * "), "Apache-2.0"),
    ("k/z.js", "/* " + MPL_HEADER.replace("\n", "\n * ") + " */\ncode", "MPL-2.0"),
    ("k/s.rs", "// SPDX-License-Identifier: Apache-2.0\nfn main() {}", "Apache-2.0"),
    ("k/t.rs", "// SPDX-License-Identifier: GPL-3.0-or-later\nfn main() {}", "GPL-3.0"),
    ("k/m.py", comment(NAMED + TEXTS["MIT"].split("\n\n", 2)[2]), "MIT"),
    ("k/b.py", comment(NAMED + TEXTS["BSD-3-Clause"].split("\n\n", 2)[2]), "BSD-3-Clause"),
    ("k/g.txt", GPL_HEADER, "GPL-3.0"),
    ("k/p.txt", "text\nCopyright. All rights reserved.\nmore", "Proprietary"),
    ("k/q.txt", "text\nAll rights reserved.\nReleased under the MIT License.", "MIT"),
    ("k/n.txt", "a license to use the software is a fine thing, it says here", None),
]


def test_real_wordings(spark):
    got = scanned(spark, [(i, p, t) for i, (p, t, _) in enumerate(WANTED)])
    assert {p: got[i][0] for i, (p, _, _) in enumerate(WANTED)} == {p: want for p, _, want in WANTED}


def test_equals_plain_version(spark, sf_dir):
    docs = licenses.document_paths(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "path", "text")
    files = [(10_000 + i, p, t) for i, (p, t, _) in enumerate(WANTED)]
    files += [(r["doc_id"], r["path"], r["text"]) for r in docs.collect()]
    files += [(20_001, "k/deep/er/x.py", "code"), (20_002, "a/b/c/d.py", ""), (20_003, None, "Released under the MIT License."), (20_004, "top.py", None), (20_005, "a/COPYING", "Licensed under the Apache License, Version 2.0."), (20_006, "ab/x", "q"), (20_007, "a/x", "MIT " * 9 + "License\n" + "word " * 100_000)]
    want, got = plain_scan(files), scanned(spark, files)
    assert {d: g[:3] for d, g in got.items()} == {d: w[:3] for d, w in want.items()}
    assert all(got[d][3] == pytest.approx(want[d][3], abs=1e-8) for d in want if want[d][3] is not None)
    assert {w[1] for w in want.values()} == {"file", "header", "inherited", None}


def test_repeated_and_empty_rows(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (1, "a/LICENSE", "Released under the MIT License."), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    assert sorted(str(r["license"]) for r in licenses.scan(df).collect()) == ["MIT", "MIT", "None"]
    assert licenses.scan(df.limit(0)).count() == 0


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    columns = ["doc_id", "path", "license", "score", "via", "found_in"]
    key = lambda r: str(tuple(round(x, 7) if isinstance(x, float) else x for x in r))
    want = sorted(map(key, con.execute(f"SELECT {', '.join(columns)} FROM ({queries.SQL['op5_licenses']})").fetchall()))
    assert sorted(key(r) for r in queries.op5_licenses(spark, sf_dir).select(*columns).collect()) == want
