"""License scans: sparse TF-IDF cosine to templates, then inheritance from ancestor directories.

Two sets of templates, both of fixed size. *Notices* are the sentences, standard
headers and SPDX tags that stand in files; they meet the lines of a text and its
blocks (lines in a row without a blank one between, so that headers wrapped over
lines are one unit). *Texts* are whole licences; they meet whole licence files.

A unit is a sparse vector: each term of a text has the weight (1 + ln n) times
its inverse document frequency among the templates of the set; a term that no
template has carries the largest; words that say nothing have none. The licence
of a unit is the template of the largest cosine, if that reaches the set's
threshold. A reservation of rights never wins over a licence of the same file.

Texts that cannot reach the threshold for a notice are left out by a bound, not
by a guess: with terms ``common`` to the notices alone, the cosine to a template
is at most the share of that template's length that lies in those terms
(Cauchy-Schwarz). Terms are put into ``common`` only as long as that share stays
below the threshold for every notice; a text with none of the other terms has no
unit that matches.

A file without a notice of its own takes the licence of the licence file in the
nearest directory above it. That is worked out once per directory: each
directory is joined to its ancestors' licences, and files are joined to their
own directory.

Only DataFrame operations are used.

Defined results
  null or empty text  no notice; may inherit
  long text           all lines and blocks count; a licence file is one unit as well
  null path           no directory; only a notice of its own counts
  ties                the licence that sorts first; notices of one text: the best score, then the first line, lines before blocks
  several licence files in a directory   the best score, then the path that sorts first
  repeated rows       each gets its row
  empty table         empty result
  extra columns       not carried
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower, written

# Public, standard wordings of notices, by SPDX identifier.
NOTICES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("Proprietary", "Copyright. All rights reserved."),
    ("Proprietary", "All rights reserved."),
    # titles of licence files
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    # standard headers of source files
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    # the paragraphs that short licences are known by
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
]
# SPDX identifiers that files are tagged with, and the licence they name.
SPDX = {
    "AGPL-3.0": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"),
    "Apache-2.0": ("Apache-2.0",),
    "BSD-2-Clause": ("BSD-2-Clause",),
    "BSD-3-Clause": ("BSD-3-Clause",),
    "CC-BY-4.0": ("CC-BY-4.0",),
    "CC-BY-NC-4.0": ("CC-BY-NC-4.0",),
    "CC0-1.0": ("CC0-1.0",),
    "GPL-2.0": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"),
    "GPL-3.0": ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"),
    "ISC": ("ISC",),
    "LGPL-2.1": ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"),
    "LGPL-3.0": ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "MIT": ("MIT",),
    "MPL-2.0": ("MPL-2.0",),
    "Unlicense": ("Unlicense",),
    "Zlib": ("Zlib",),
}
# Words without a weight.
STOP = "a all an and any are as at be by for from has have if in is it its may no not of on or other such that the their this to under was which will with work you your".split()
#: Words that texts are full of, most frequent first: the first that do not tell a notice.
FREQUENT = "2 3 19 29 1.0 2.0 2.1 1991 do so can v into must list either use used copy name names person anyone version terms one file form free later software code source program library language general license subject following conditions copies".split()
#: Whole licences, one file each; public texts, named by SPDX identifier.
FOLDER = Path(__file__).with_name("license_texts")
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENSE_FILE = r"(?i)(^|/)((un)?licen[cs]e|copying|notice)([.-][^/]*)?$"
RESERVED = "Proprietary"
NOTICE_THRESHOLD, TEXT_THRESHOLD = 0.6, 0.75
#: Unit numbers: the whole file, then lines from 0, then blocks.
WHOLE, BLOCKS = -1, 1 << 30


def notices() -> list[tuple[str, str]]:
    """(license, wording) of all notices, SPDX tags included."""
    return [*NOTICES, *((k, f"SPDX-License-Identifier: {name}") for k, names in SPDX.items() for name in names)]


def texts() -> list[tuple[str, str]]:
    """(license, text) of whole licences; the Affero one differs from the general one in its name and section 13."""
    found = {f.stem: f.read_text(encoding="utf-8") for f in sorted(FOLDER.glob("*.txt"))}
    own = "Remote Network Interaction. If you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge."
    affero = found["GPL-3.0"].replace("GNU GENERAL", "GNU AFFERO GENERAL").replace("GNU General", "GNU Affero General")
    found["AGPL-3.0"] = re.sub(r"(?s)Use with the GNU Affero.*?\n\n  14\.", f"{own}\n\n  14.", affero, count=1)
    return sorted(found.items())


def terms_of(text: str) -> Counter:
    """Terms and their numbers, those without a weight left out."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return Counter(t for t in re.findall(TERM, lower) if t not in STOP)


class Weights:
    """Inverse document frequencies of a set of templates, and their normed vectors."""

    def __init__(self, templates: list[tuple[str, str]]):
        counts = [terms_of(t) for _, t in templates]
        df = Counter(t for c in counts for t in c)
        self.licenses = [k for k, _ in templates]
        self.unknown = math.log(1 + len(counts)) + 1
        self.idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in df.items()}
        self.rows: dict[str, list[float]] = {t: [0.0] * len(counts) for t in self.idf}
        for i, c in enumerate(counts):
            norm = math.sqrt(sum(((1 + math.log(n)) * self.idf[t]) ** 2 for t, n in c.items()))
            for t, n in c.items():
                self.rows[t][i] = (1 + math.log(n)) * self.idf[t] / norm

    def telling(self, threshold: float) -> list[str]:
        """Terms of which a unit that reaches the threshold has one at least."""
        place = {t: i for i, t in enumerate(FREQUENT)}
        share, common = [0.0] * len(self.licenses), set()
        for term in sorted(self.idf, key=lambda t: (place.get(t, len(place)), self.idf[t], len(t), t)):
            more = [a + w * w for a, w in zip(share, self.rows[term], strict=True)]
            if max(more) < (threshold - 1e-6) ** 2:
                share = more
                common.add(term)
        return sorted(set(self.idf) - common)


def any_of(words: list[str]) -> str:
    """A pattern for any of the sorted words as whole terms, A-Z like a-z, words with one first character together."""
    groups: dict[str, list[str]] = {}
    for w in words:
        groups.setdefault(w[0], []).append(re.escape(w[1:]))
    first = "".join(map(re.escape, groups))  # looked at before the words are tried one after another
    return rf"(?i)(?<![a-z0-9])(?=[{first}])(?:" + "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in groups.items()) + r")(?![a-z0-9])"


def _once(value: Column | str, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once: a lambda variable stands for it."""
    return F.element_at(F.transform(F.array(value), lambda x: then(x)), 1)


def may_reach(terms: Column, w: Weights, threshold: float) -> Column:
    """Whether a unit can reach the threshold, by a bound.

    Of its squared length, terms of templates must make up the threshold's
    square. They make up (1 + ln n)^2 of the largest frequency each at most,
    n being what repetitions allow, and each unknown term at least one.
    """
    counts = F.struct(
        F.size(terms).alias("all"),
        F.size(F.array_distinct(terms)).alias("distinct"),
        F.size(F.array_intersect(terms, F.lit([*w.idf]))).alias("known"),
        F.size(F.array_intersect(terms, F.lit(STOP))).alias("stop"),
    )

    def bound(c: Column) -> Column:
        most = c["known"] * F.pow(1 + F.log(c["all"] - c["distinct"] + 1), 2)
        return most * (1 - threshold**2) >= (c["distinct"] - c["known"] - c["stop"]) * threshold**2 - 1e-6

    return _once(counts, bound)


def matches(units: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """(key, line, license, score): the best template of each unit (key, line, body) that reaches the threshold."""
    spark, w = units.sparkSession, Weights(templates)
    stop = [(t, 0.0, [0.0] * len(w.licenses)) for t in STOP]
    known = spark.createDataFrame([(t, w.idf[t], w.rows[t]) for t in w.idf] + stop, "term string, idf double, weights array<double>")
    units = units.select("key", "line", F.regexp_extract_all(ascii_lower(F.col("body")), F.lit(TERM), F.lit(0)).alias("terms"))
    units = units.where(_once("terms", lambda terms: may_reach(terms, w, threshold))).select("key", "line", F.sort_array("terms").alias("terms"))
    # a unit's length takes all its terms, in order, so equal ones follow each other: all are taken as unknown here, and
    # those of templates, the only ones that leave the row, are put right below
    times = lambda n: 1 + F.log(n)
    state = lambda term, n, total: F.named_struct(F.lit("term"), term, F.lit("n"), n, F.lit("sum"), total)

    def closed(run: Column) -> Column:
        return run["sum"] + F.when(run["n"] > 0, F.pow(times(run["n"]), 2)).otherwise(0.0)

    def count(run: Column, term: Column) -> Column:
        return F.when(run["term"] == term, state(run["term"], run["n"] + 1, run["sum"])).otherwise(state(term, F.lit(1.0), closed(run)))

    length = F.aggregate("terms", state(F.lit(""), F.lit(0.0), F.lit(0.0)), count, closed)
    # the length is worked out below the explode, once a unit; no condition is drawn from an outer explode, and no lambda
    # holds the terms, which would be worked out again for each of them
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("terms", 1, F.greatest(F.size("terms") - 1, F.lit(0))))
    sparse = units.select("key", "line", length.alias("length"), F.arrays_zip(F.col("terms").alias("term"), before.alias("before")).alias("terms"))
    sparse = sparse.select("key", "line", "length", F.explode_outer("terms").alias("t"))
    sparse = sparse.select("key", "line", "length", "t.term", (~F.col("t.term").eqNullSafe(F.col("t.before"))).alias("first")).join(F.broadcast(known), "term")
    # equal rows make the same unit more than once
    sparse = sparse.groupBy("key", "line", "term").agg((F.count("*") / F.count_if("first")).alias("n"), F.first("length").alias("length"), F.first("idf").alias("idf"), F.first("weights").alias("weights"))
    n = times(F.col("n"))
    dots = [F.sum(n * F.col("idf") * F.col("weights")[i]).alias(f"d{i}") for i in range(len(w.licenses))]
    square = F.first("length") * w.unknown**2 - F.sum(n * n * (w.unknown**2 - F.col("idf") ** 2))
    scored = sparse.groupBy("key", "line").agg(F.sqrt(square).alias("norm"), *dots).where("norm > 0")
    best = F.array_min(F.array(*[F.struct((-F.round(F.col(f"d{i}") / F.col("norm"), 9)).alias("s"), F.lit(k).alias("license")) for i, k in enumerate(w.licenses)]))
    return scored.select("key", "line", best.alias("b")).select("key", "line", "b.license", (-F.col("b.s")).alias("score")).where(F.col("score") >= threshold)


def directory(path: Column) -> Column:
    """The path without its last step; '' at the top."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/+$", "")


def scan(files: DataFrame, doc_id: str = "doc_id", path: str = "path", text: str = "text", license_file: str = LICENSE_FILE) -> DataFrame:
    """Per row: doc_id, path, license, score, via (``file``, ``header``, ``inherited`` or null), found_in (directory)."""
    rows = files.select(F.col(doc_id).alias("doc_id"), F.col(path).alias("path"), F.col(text).alias("text"), F.xxhash64(path, text).alias("h"))
    key = F.struct("doc_id", "h").alias("key")
    is_file = F.coalesce(F.col("path").rlike(license_file), F.lit(False))
    short = notices()
    tells = any_of(Weights(short).telling(NOTICE_THRESHOLD))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("body"))), lambda x: F.length(x["body"]) > 0)
    parts = F.transform(F.split("text", r"\n[ \t\r\n]*\n"), lambda x, i: F.struct((i + BLOCKS).alias("line"), F.btrim(x, F.lit(" \t\r\n")).alias("body")))
    blocks = F.filter(parts, lambda x: F.contains(x["body"], F.lit("\n")))
    told = rows.where(F.col("text").rlike(tells))
    units = told.select(key, F.explode(F.concat(lines, blocks)).alias("x")).select("key", "x.line", "x.body")
    found = matches(units.where(F.col("body").rlike(tells)), short, NOTICE_THRESHOLD)
    whole = rows.where(is_file & F.col("text").isNotNull()).select(key, F.lit(WHOLE).alias("line"), F.col("text").alias("body"))
    found = found.union(matches(whole, texts(), TEXT_THRESHOLD))
    # what reserves all rights comes after any licence
    best = F.min(F.struct((F.col("license") == RESERVED).alias("reserved"), (-F.col("score")).alias("s"), "line", "license")).alias("b")
    own = found.groupBy("key").agg(best).select("key", "b.license", (-F.col("b.s")).alias("score"))
    # rows without their text: ids, paths and what was found
    slim = rows.select(key, "doc_id", "path", is_file.alias("is_file"), directory(F.col("path")).alias("dir")).join(own, "key", "left")
    slim = written(slim, "licenses")
    granted = slim.where("is_file AND license IS NOT NULL").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("g")).select("dir", F.col("g.license").alias("license"), (-F.col("g.s")).alias("score"))
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, 1, n), "/").alias("up")))
    dirs = slim.where("dir IS NOT NULL").select("dir").distinct().select("dir", F.explode(F.array_union(above, F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("up"))))).alias("a")).select("dir", "a.depth", "a.up")
    near = dirs.join(granted.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by(F.struct("license", "score", "up"), "depth").alias("near"))
    out = slim.join(near, "dir", "left")
    has = F.col("license").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.coalesce("license", "near.license").alias("license"),
        F.coalesce("score", "near.score").alias("score"),
        F.when(has & F.col("is_file"), "file").when(has, "header").when(F.col("near").isNotNull(), "inherited").alias("via"),
        F.when(has, F.col("dir")).otherwise(F.col("near.up")).alias("found_in"),
    )


def document_paths(docs: DataFrame, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``documents`` has no paths: source / thousands / tens / file, each tenth file being its directory's LICENSE."""
    n = F.col(doc_id)
    name = F.when(n % 10 == 0, F.lit("LICENSE")).otherwise(F.concat(n.cast("string"), F.lit(".txt")))
    return docs.withColumn("path", F.concat_ws("/", source, F.expr(f"cast({doc_id} div 1000 as string)"), F.expr(f"cast({doc_id} div 10 as string)"), name))
