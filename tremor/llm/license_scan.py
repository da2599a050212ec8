"""License scans with DataFrame functions only (operator 9).

A text becomes its words (runs of a-z and 0-9 after lower-casing) and their shingles, hashed.  The
shingles are cut into overlapping windows, one starting at each shingle; a window's MinHash signature
has ``BANDS`` bands of one row, each the least of the window's hashes under its own mask.  Template
texts are cut into pieces of ``PIECE`` shingles (the last one reaches back; a shorter template is one
piece) and signed alike.  A text with fewer shingles than a piece is one window of its own length.
A template is retrieved when any band of any of its pieces meets an equal
key among the windows of that length.  It matches when the text holds at least 80 % of its distinct
shingles, counted exactly.

Bands: windows start at every shingle, so a verbatim piece is itself a window and collides for sure;
a window of similarity s collides with probability 1 - (1 - s) ** 8, which is 0.996 at s = 0.5 and
0.99999 at s = 0.8, for each of the pieces of a template.  The masks are XORed to 64-bit hashes, so the
order under a mask depends on the bits in which two hashes first differ; the 8 orders are not independent
in theory, and a test measures the recall over edited templates.

Texts in which no anchor word occurs skip the windows.  Anchors are derived from the templates so
that more than a fifth of every template's distinct shingles hold one; a text without any anchor
therefore cannot hold 80 % of a template, and skipping it loses nothing.

Everything is one projection per row: no shuffle, no Python.
Defined results: a null or empty text matches nothing; a text or template shorter than a shingle is
one shingle of all its words; repeated rows give repeated matches; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
PIECE = 8
BANDS = 8
CONTAINED_PER_CENT = 80

# Notices and first clauses of public licenses.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0 disclaimer": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

_MASKS = [(0x9E3779B97F4A7C15 * (2 * j + 1)) & 0x7FFFFFFFFFFFFFFF for j in range(BANDS)]


def _words_sql(text: str) -> str:
    plain = f"trim(regexp_replace(lower(coalesce({text}, '')), '[^a-z0-9]+', ' '))"
    return f"CASE WHEN {plain} = '' THEN CAST(array() AS array<string>) ELSE split({plain}, ' ') END"


def _shingles_sql(words: str) -> str:
    run = ", ".join(f"{words}[i + {k}]" for k in range(SHINGLE))
    return (
        f"CASE WHEN size({words}) >= {SHINGLE} THEN transform(sequence(0, size({words}) - {SHINGLE}), i -> xxhash64({run}))"
        f" WHEN size({words}) > 0 THEN array(xxhash64(array_join({words}, ' '), 1)) ELSE CAST(array() AS array<bigint>) END"
    )


def _band_sql(window: str, j: int) -> str:
    return f"xxhash64(array_min(transform({window}, x -> x ^ {_MASKS[j]}L)), {j})"


def words_of(text: str) -> list[str]:
    """The words of a text, as the projection makes them (for templates and anchors only)."""
    return "".join(c if c.isascii() and (c.isalnum()) else " " for c in text.lower()).split()


def template_table(spark: SparkSession, templates: dict[str, str]) -> list[dict]:
    """name, distinct shingles, piece length and band keys of every template: a few small rows."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string").selectExpr("name", f"{_words_sql('text')} AS w").selectExpr("name", f"{_shingles_sql('w')} AS h")
    length = f"least({PIECE}, size(h))"
    starts = f"transform(sequence(0, greatest(0, size(h) - 1), {PIECE}), i -> least(i, size(h) - {length}))"
    bands = ", ".join(_band_sql("p", j) for j in range(BANDS))
    return [
        r.asDict()
        for r in rows.where("size(h) > 0")
        .selectExpr("name", "h", f"{length} AS length", f"transform({starts}, s -> slice(h, s + 1, {length})) AS pieces")
        .selectExpr("name", "array_distinct(h) AS shingles", "length", f"array_distinct(flatten(transform(pieces, p -> array({bands})))) AS keys")
        .collect()
    ]


def anchors(templates: dict[str, str]) -> list[str]:
    """Words such that every template has more than a fifth of its distinct shingles with one of them."""
    runs = {}
    for name, text in templates.items():
        w = words_of(text)
        runs[name] = {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()
    chosen: list[str] = []

    def lacking() -> list[str]:
        return [n for n, r in runs.items() if r and 100 * sum(any(a in s for a in chosen) for s in r) <= (100 - CONTAINED_PER_CENT) * len(r)]

    while open_ := lacking():
        bare = [s for n in open_ for s in runs[n] if not any(a in s for a in chosen)]  # never empty: such a template has four fifths of them
        gain = Counter(word for s in bare for word in set(s) if len(word) > 3) or Counter(word for s in bare for word in set(s))
        chosen.append(min(gain, key=lambda w: (-gain[w] * len(w), w)))
    return sorted(chosen)


def _longs(values: list[int]) -> str:
    return "array(" + ", ".join(f"{v}L" if v > -(1 << 63) else "CAST(-9223372036854775808 AS bigint)" for v in values) + ")"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, n_shingles, n_found of every license that a text of ``docs`` holds."""
    templates = TEMPLATES if templates is None else templates
    signed = template_table(docs.sparkSession, templates)
    kinds = "doc_id long, license string, n_shingles long, n_found long"
    if not signed:
        return docs.sparkSession.createDataFrame([], kinds)
    lengths = sorted({t["length"] for t in signed})
    anchored = " OR ".join(f"contains(low, '{a}')" for a in anchors(templates))
    rows = (
        docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "lower(coalesce(CAST(text AS string), '')) AS low")
        .where(anchored)
        .selectExpr("doc_id", f"{_words_sql('low')} AS w")
        .selectExpr("doc_id", f"{_shingles_sql('w')} AS h")
    )
    met = []
    for m in lengths:
        keys = _longs(sorted({k for t in signed if t["length"] == m for k in t["keys"]}))
        bands = ", ".join(_band_sql("p", j) for j in range(BANDS))
        windows = f"flatten(transform(sequence(1, greatest(1, size(h) - {m - 1})), s -> transform(array(slice(h, s, {m})), p -> array({bands}))[0]))"
        met.append(f"CASE WHEN size(h) > 0 THEN array_intersect({keys}, {windows}) ELSE CAST(array() AS array<bigint>) END AS met{m}")
    rows = rows.selectExpr("doc_id", "h", *met)
    found = [
        f"IF(arrays_overlap(met{t['length']}, {_longs(t['keys'])}), named_struct('license', {_quoted(t['name'])}, 'n_shingles', {len(t['shingles'])}L, "
        f"'n_found', CAST(size(array_intersect({_longs(t['shingles'])}, h)) AS bigint)), NULL)"
        for t in signed
    ]
    return (
        # no filter before the explode: pushed into the projections, it would compute them once more per element
        rows.selectExpr("doc_id", f"explode(filter(array({', '.join(found)}), x -> x IS NOT NULL)) AS m")
        .where(100 * F.col("m.n_found") >= CONTAINED_PER_CENT * F.col("m.n_shingles"))
        .select("doc_id", "m.license", "m.n_shingles", "m.n_found")
    )
