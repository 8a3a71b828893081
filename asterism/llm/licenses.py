"""Operator 3: license scans, with DataFrame functions only.

A text is its words, lower-cased and without punctuation; what has no letter or
digit, as the markers of comment lines, is no word.  A shingle is five words.  Overlapping windows of four shingles, at every second shingle, get three
MinHash values, each a band of its own; templates of fewer than ``SHORT`` shingles are
posted by their single shingles, windows of one.  A band that a template's window (at any
offset) has retrieves the template, and the share of the template's shingles
that the text holds, counted on the words themselves, decides.

What this finds: short templates always, as any shared shingle retrieves them.  In a longer one
of t shingles an edit that brings in other words, or takes words out, breaks at least four, so at a containment of
0.8 there are at most t / 20 gaps and a run of at least 0.8 t / (t / 20 + 1) unbroken shingles, which is
more than five and covers a whole window, equal to one of the
template's: similarity 1, so all bands collide.  Only insertions that repeat the template's own words can break fewer;
windows that are broken still collide with probability 1 - (1 - J)^3, 0.94 at J = 0.6.  The tests measure the
recall against all shingles on texts with edits of both kinds: no finding is missed.

Scale: one narrow pass without shuffle, join or Python; templates are constants of
the plan.  A plan can't hold any number of constants, so a longer list is scanned in several passes of at most
MAX_SHINGLES shingles or one template; what is left out for a better template is decided over all of them together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, WINDOW, STRIDE, SHORT, CONTAINMENT = 5, 4, 2, 30, 0.8
#: One for each band.
_SALTS = (0x1F3D5B79A2C4E688, 0x6A09E667F3BCC908, 0x3C6EF372FE94F82B)
MAX_SHINGLES = 4000
# Parts that several notices share.
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_MIT_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_GPL = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
# License notices, (SPDX identifier, words of the notice).  Licenses that share clauses are whole, so that each holds what tells it from the others.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", f"{_MIT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_MIT_AS_IS}"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GPL.format("program", "General Public License", "3")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAMES} {_BSD_AS_IS}"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_AS_IS}"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSD-2-Clause", f"{_BSD} {_BSD_AS_IS}"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("0BSD", f"{_ISC}. {_ISC_AS_IS}"),
    ("MIT-0", f"{_MIT}. {_MIT_AS_IS}"),
    ("GPL-2.0", _GPL.format("program", "General Public License", "2")),
    ("LGPL-2.1", _GPL.format("library", "Lesser General Public License", "2.1")),
    ("LGPL-3.0", _GPL.format("program", "Lesser General Public License", "3")),
    ("AGPL-3.0", _GPL.format("program", "Affero General Public License", "3")),
)
PUNCTUATION = ".,;:!?()\"'"


def words_of(text: Column) -> Column:
    plain = F.translate(F.lower(F.coalesce(text.cast("string"), F.lit(""))), PUNCTUATION, "")
    # between words stand blanks, and whatever has no letter or digit between them
    return F.array_remove(F.split(F.concat(F.lit(" "), plain, F.lit(" ")), r"[\x20\x09-\x0D](?:[^\p{L}\p{N}]*[\x20\x09-\x0D])?"), "")


def _hashes(words: Column) -> Column:
    n = F.size(words) - (SHINGLE - 1)
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, F.lit(SHINGLE))))).otherwise(F.array().cast("array<bigint>"))


def _texts(words: Column) -> Column:
    n = F.size(words) - (SHINGLE - 1)
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat_ws(" ", F.slice(words, i, F.lit(SHINGLE))))).otherwise(F.array().cast("array<string>"))


def _band(hashes: Column, salt: int, step: int) -> Column:
    """One MinHash value of the window at every step-th shingle."""

    def least(at: Column) -> Column:
        return F.least(*[F.get(hashes, at + j).bitwiseXOR(F.lit(salt)) for j in range(WINDOW)])

    last = F.size(hashes) - WINDOW
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last, F.lit(step)), least)).otherwise(F.array().cast("array<bigint>"))


def _posted(spark, templates: Sequence[tuple[str, str]]) -> list[dict]:
    """Each template's shingles and the values it is posted under, by the same expressions as for texts."""
    df = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "id int, license string, text string")
    df = df.select("id", "license", words_of(F.col("text")).alias("words")).select("*", _hashes(F.col("words")).alias("h"), F.array_distinct(_texts(F.col("words"))).alias("shingles"))
    bands = [_band(F.col("h"), salt, 1) for salt in _SALTS]
    short = F.size("shingles") < SHORT
    empty = F.array().cast("array<bigint>")
    rows = df.select("id", "license", "shingles", F.when(short, F.col("h")).otherwise(empty).alias("single"), *[F.when(short, empty).otherwise(b).alias(f"band{k}") for k, b in enumerate(bands)]).collect()
    for r in rows:
        if not r.shingles:
            raise ValueError(f"a template needs {SHINGLE} words: {templates[r.id][1]!r}")
    return [r.asDict() for r in rows]


def _among(values: Column, numbers: set[int]) -> Column:
    """Those of the values that are among the numbers."""
    return F.filter(values, lambda x: x.isin(sorted(numbers)) if numbers else F.lit(False))


def _scan(docs: DataFrame, templates: Sequence[tuple[str, str]], containment: float) -> DataFrame:
    posted = _posted(docs.sparkSession, templates)
    single = {x for t in posted for x in t["single"]}
    bands = [{x for t in posted for x in t[f"band{k}"]} for k in range(len(_SALTS))]
    hashed = docs.select("doc_id", words_of(F.col("text")).alias("words")).select("doc_id", "words", _hashes(F.col("words")).alias("h"))
    h = F.col("h")
    hits = [_among(h, single), *[_among(_band(h, salt, STRIDE), b) for salt, b in zip(_SALTS, bands)]]
    # the generator keeps the optimizer from evaluating the arrays again for each of their uses
    found = hashed.select("doc_id", "words", F.explode(F.array(F.array_distinct(F.concat(*hits)))).alias("hits")).where(F.size("hits") > 0)
    groups, held = [[]], 0
    for t in posted:
        if held + len(t["shingles"]) > MAX_SHINGLES and groups[-1]:
            groups.append([])
            held = 0
        groups[-1].append(t)
        held += len(t["shingles"])
    known = [F.array(*[F.struct(F.lit(t["license"]).alias("license"), F.lit(t["id"]).alias("template"), F.array(*map(F.lit, t["shingles"])).alias("shingles"), F.array(*[F.lit(x) for x in sorted({*t["single"], *t["band0"], *t["band1"], *t["band2"]})]).alias("posted")) for t in group]) for group in groups]
    texts = found.select("doc_id", "hits", F.explode(F.array(_texts(F.col("words")))).alias("texts"))
    retrieved = [F.filter(k, lambda t: F.arrays_overlap(t["posted"], F.col("hits"))) for k in known]
    checked = [F.transform(x, lambda t: F.struct(t["license"].alias("license"), t["template"].alias("template"), F.array_intersect(F.col("texts"), t["shingles"]).alias("found"), F.size(t["shingles"]).cast("long").alias("total"))) for x in retrieved]
    enough = F.concat(*[F.filter(x, lambda m: F.size(m["found"]) / m["total"] >= containment) for x in checked])
    held = texts.select("doc_id", F.explode(F.array(enough)).alias("held"))

    def better(m: Column) -> Column:
        """Whether a template of higher containment has all that this one has found."""
        return F.exists("held", lambda o: (F.size(o["found"]) * m["total"] > F.size(m["found"]) * o["total"]) & (F.size(F.array_except(m["found"], o["found"])) == 0))

    out = held.select("doc_id", F.explode(F.filter("held", lambda m: ~better(m))).alias("m"))
    shared = F.size("m.found").cast("long")
    return out.select("doc_id", "m.license", "m.template", shared.alias("shared"), "m.total", (shared / F.col("m.total")).alias("containment"))


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, template, shared, total, containment) for each template that a row of docs (doc_id, text) contains.

    template: its place in the list; shared of total: its distinct shingles found
    in the text.  A template is left out if all that it found belongs to one of
    higher containment, as with two versions of one notice.

    Null, empty and short texts contain nothing.  Repeated rows are reported
    each; a null doc_id stays null.  No templates or an empty table give an
    empty result; other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    if not templates:
        return docs.sparkSession.createDataFrame([], "doc_id long, license string, template int, shared long, total long, containment double")
    return _scan(docs, templates, containment)
