"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Texts and templates are split into words and shingles of five words (a template of fewer words is one shingle of them all).
A text is covered by overlapping windows and each window by band keys; a template's own band keys retrieve the texts that may
hold it, by a join. Then the exact share of the template's distinct shingles in a stretch of text decides, the stretch being a
quarter longer than the template.

Retrieval is guaranteed as follows.

* A template of up to ``SMALL`` shingles is looked for in windows of one shingle, whose least hash is the shingle's own. Of its least
  shingles it has one key more than a copy may lack, so every copy is found.
* A longer one is looked for in the next longer of the windows of 48, 64, 96, 128, 192, ... shingles, which stand half a window apart.
  ``HASHES`` hash functions give a signature, and each band is the pair of neighbouring functions (the last and the first are
  neighbours), so that a band has two rows. :func:`collision` is the probability that a window of a given Jaccard similarity meets its
  template in a band. At worst (a template just longer than two thirds of its window) an exact copy is 0.66 similar to one of its
  windows and is found with 0.998, and a copy with 0.8 of the shingles is 0.47 similar and is found with 0.95.

Templates are a table and are joined, whatever their number; Catalyst broadcasts them by their stored size. Texts are retrieved and
checked once, however many copies there are. Everything is built from DataFrame functions.

Defined results: null, empty and short texts without a shingle match nothing; repeated rows are each reported; of equally good places the
first is reported; templates with equal words are reported under each name; a template without words is an error; a very long text costs
time and memory in proportion; an empty table gives an empty table; other columns, whatever their names, are not read. ``start`` and
``end`` are word places, the end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frametide.llm.common import dropped, let, phrase_words, table, written

SHINGLE = 5
MIN_CONTAINMENT = 0.8
#: Hash functions of a signature, and its bands.
HASHES = 16
#: Shingles over which minima are first taken. Windows are two blocks of 3 or 4 times a power of two of these.
BLOCK = 8
#: Templates of up to so many distinct shingles are looked for in windows of one.
SMALL = 39

# Usual license notices, and the published texts of short licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
    "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
    "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
    "FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
    "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear "
    "in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
    "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
    "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
    "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
    "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is "
    "granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software "
    "must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
    "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "rights-reserved": "All rights reserved",
}


def collision(similarity: float, hashes: int = HASHES) -> float:
    """The probability that sets of this Jaccard similarity agree in two neighbouring functions: 1 less that of no two
    neighbours in the circle, by the eigenvalues of its transfer matrix."""
    miss = 1 - similarity
    root = (miss * miss + 4 * similarity * miss) ** 0.5
    return 1 - ((miss + root) / 2) ** hashes - ((miss - root) / 2) ** hashes


def _shingles(h: Column, width: int) -> Column:
    """Hashes of the runs of ``width`` words, in place order; ``h``: the words' hashes, a variable."""
    runs = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width))))
    return F.when(F.size(h) >= width, runs).otherwise(F.array().cast("array<bigint>"))


def _minima(sets: Column) -> Column:
    """For each hash function, the least hash of each of ``sets``."""
    return F.transform(_functions(), lambda f: F.transform(sets, lambda b: F.array_min(F.transform(b, lambda x: F.xxhash64(x, f)))))


def _functions() -> Column:
    return F.sequence(F.lit(0), F.lit(HASHES - 1))


def _bands(minima: Column) -> Column:
    """Keys of bands. ``minima``: by function, an array of minima; each pair of neighbouring functions gives an array of keys."""
    return F.transform(_functions(), lambda b: F.zip_with(F.get(minima, b), F.get(minima, (b + 1) % HASHES), lambda x, y: F.xxhash64(x, y)))


def _merged(minima: Column, n: int) -> Column:
    """Minima of blocks that are ``n`` times as long."""
    last = lambda a: F.floor((F.size(a) - 1) / n).cast("int")
    return F.transform(minima, lambda a: F.transform(F.sequence(F.lit(0), last(a)), lambda j: F.least(*(F.get(a, j * n + k) for k in range(n)))))


def _window_keys(s: Column, windows: list[int]) -> Column:
    """The keys of every band of every window of the given lengths, as one array."""

    def keys(m: Column) -> Column:
        # a window is two neighbouring blocks; the last one has but one
        pairs = F.transform(m, lambda a: F.transform(a, lambda x, j: F.least(x, F.get(a, j + 1))))
        return let(pairs, lambda w: F.flatten(_bands(w)))

    def ladder(m: Column, size: int, own: list[int]) -> Column:
        """``m``: minima of blocks of ``size``; ``own``: the windows that are made of these or of longer ones."""
        here = [keys(m)] if 2 * size in own else []
        above = [let(_merged(m, 2), lambda x: ladder(x, 2 * size, own))] if max(own) > 2 * size else []
        return F.concat(*here, *above)

    def both(m: Column) -> Column:
        found = []
        for n in (3, 4):
            own = [w for w in windows if (w % 3 == 0) == (n == 3)]
            if own:
                found.append(let(_merged(m, n), lambda x: ladder(x, n * BLOCK, own)))
        return F.concat(*found)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), lambda j: F.slice(s, j * BLOCK + 1, BLOCK))
    return F.when(F.size(s) >= SMALL // 2, let(let(blocks, _minima), both)).otherwise(F.array().cast("array<bigint>"))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """``license, text`` of templates that are few enough to be literals; a larger set is read from a table."""
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(n).alias("license"), F.lit(t).alias("text")) for n, t in templates.items()))))


def prepared(templates: DataFrame, min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """``license, width, shingles`` (distinct), ``window``, ``stretch`` and ``keys`` of each template."""
    h = templates.select("license", F.transform(phrase_words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    h = h.withColumn("width", F.least(F.size("h"), F.lit(SHINGLE)))
    every = F.coalesce(*(F.when(F.col("width") == w, _shingles(F.col("h"), w)) for w in range(1, SHINGLE + 1)), F.array().cast("array<bigint>"))
    t = h.select("license", "width", every.alias("s")).withColumns({"shingles": F.array_distinct("s"), "places": F.size("s")})
    n = F.size("shingles")
    longer = [F.pow(F.lit(2), F.greatest(F.ceil(F.log2(F.col("places") / least) - 1e-9), F.lit(0))).cast("int") * least for least in (6 * BLOCK, 8 * BLOCK)]
    t = t.withColumn("window", F.when(n <= SMALL, 1).otherwise(F.least(*longer)))
    t = t.withColumn("stretch", F.col("places") + F.ceil(F.col("places") / 4).cast("int"))
    least = F.slice(F.array_sort("shingles"), 1, F.floor(n * (1 - min_containment) + 1e-9).cast("int") + 1)
    bands = let(let(F.array("shingles"), _minima), lambda m: F.flatten(_bands(m)))
    return t.select("license", "width", "shingles", "window", "stretch", F.when(F.col("window") == 1, least).otherwise(bands).alias("keys"))


def best_stretch(s: Column, shingles: Column, stretch: Column, width: Column) -> Column:
    """``n, from, end``: the most distinct shingles of a template that a stretch of ``s`` has, where the first such stretch begins (negative,
    so that of equals the first is the greatest), and the word after its last such shingle."""

    def of(ps: Column) -> Column:
        def one(p: Column, k: Column) -> Column:
            own = F.filter(F.slice(ps, k + 1, stretch), lambda q: q["i"] < p["i"] + stretch)  # places are in order, so no more can be near
            return let(own, lambda o: F.struct(F.size(F.array_distinct(o["x"])).alias("n"), (-p["i"]).alias("from"), (F.array_max(o["i"]) + width).alias("end")))

        return F.array_max(F.transform(ps, one))

    places = F.filter(F.transform(s, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: F.array_contains(shingles, p["x"]))
    return let(places, of)


def scan(docs: DataFrame, templates: dict[str, str] | DataFrame = TEMPLATES, id_col: str = "doc_id", text: str = "text", min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """``doc_id, license, containment, start, end``: of each document and template, the best place (then the first).

    ``templates``: texts by name, or a table ``license, text``. A row that repeats in ``docs`` is reported once for each.
    """
    spark = docs.sparkSession
    given = template_table(spark, templates) if isinstance(templates, dict) else templates
    known, _ = written(prepared(given, min_containment), "templates")
    kinds = known.select("width", "window", (F.size("shingles") == 0).alias("empty")).distinct().collect()  # a row for each power of two at most
    if any(r["empty"] for r in kinds):
        raise ValueError("a template has no words")
    small, large = sorted({r["width"] for r in kinds if r["window"] == 1}), sorted({r["window"] for r in kinds if r["window"] > 1})
    bands, _ = written(known.select(F.explode("keys").alias("key"), "license"), "template-bands")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("k1"), F.xxhash64(F.lit("text"), F.col(text)).alias("k2"))

    def shingled(body: Callable[[dict[int, Column]], Column], widths: list[int]) -> Column:
        """``body`` of the text's shingles by width."""
        own = lambda h: F.struct(*(_shingles(h, w).alias(f"s{w}") for w in widths))
        hashed = F.transform(phrase_words(F.col("text")), lambda w: F.xxhash64(w))
        return let(let(hashed, own), lambda s: body({w: s[f"s{w}"] for w in widths}))

    def keys(s: dict[int, Column]) -> Column:
        return F.concat(*(s[w] for w in small), *([_window_keys(s[SHINGLE], large)] if large else []))

    widths = sorted({*small, *([SHINGLE] if large else [])})
    # the outer generator, as the plain one adds a filter on the array's size and so computes it twice
    looked = slim.select("k1", "k2", F.explode_outer(shingled(keys, widths)).alias("key")).filter("key is not null")
    found = looked.join(bands, "key").select("k1", "k2", "license").distinct().join(known.select("license", "width", "stretch", "shingles"), "license")
    found, path = written(found.groupBy("k1", "k2").agg(F.collect_list(F.struct("license", "width", "stretch", "shingles")).alias("found")), "license-candidates")
    texts = slim.join(found.select("k1", "k2"), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text"))

    def checked(s: dict[int, Column]) -> Column:
        def one(f: Column) -> Column:
            own = F.coalesce(*(F.when(f["width"] == w, s[w]) for w in s))
            return F.struct(f["license"].alias("license"), F.size(f["shingles"]).alias("of"), let(own, lambda x: best_stretch(x, f["shingles"], f["stretch"], f["width"])).alias("b"))

        return F.filter(F.transform("found", one), lambda x: x["b"]["n"] >= min_containment * x["of"] - 1e-9)

    near = texts.join(found, ["k1", "k2"]).select("k1", "k2", F.explode_outer(shingled(checked, widths)).alias("x")).filter("x is not null")
    best, _ = written(near.select("k1", "k2", "x.*"), "licenses-found")
    dropped(spark, path)
    out = slim.select("doc_id", "k1", "k2").join(best, ["k1", "k2"])
    return out.select("doc_id", "license", (F.col("b.n") / F.col("of")).alias("containment"), (-F.col("b.from")).cast("long").alias("start"), F.col("b.end").cast("long").alias("end"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _values(templates: dict[str, str]) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in templates.items())


def oracle(templates: dict[str, str] = TEMPLATES) -> str:
    """Exact containment of every template in every stretch of every text, without windows and bands."""
    split = (
        "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    )
    return f"""
WITH t AS (SELECT license, w, least({SHINGLE}, len(w)) AS k FROM (SELECT license, {split} AS w FROM (VALUES {_values(templates)}) AS v(license, text))
), ts AS (SELECT license, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM t)
), n AS (SELECT license, any_value(k) AS k, count(DISTINCT s) AS n, count(*) + CAST(ceil(count(*) / 4) AS BIGINT) AS stretch FROM ts GROUP BY license
), d AS (SELECT row_number() OVER () AS r, doc_id, {split} AS w FROM documents
), ds AS (SELECT r, k, i - 1 AS p, array_to_string(w[i : i + k - 1], ' ') AS s
          FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM t) AS ks WHERE len(w) >= k)
), m AS (SELECT DISTINCT r, license, p, s FROM ds JOIN ts USING (k, s)
), st AS (SELECT a.r, a.license, a.p, count(DISTINCT b.s) AS c, max(b.p) AS last_
          FROM m AS a JOIN n ON n.license = a.license JOIN m AS b ON b.r = a.r AND b.license = a.license AND b.p >= a.p AND b.p < a.p + n.stretch GROUP BY a.r, a.license, a.p
), best AS (SELECT r, license, max({{'c': c, 'f': -p, 'l': last_}}) AS x FROM st GROUP BY r, license)
SELECT doc_id, license, x.c / n.n AS containment, CAST(-x.f AS BIGINT) AS start, CAST(x.l + n.k AS BIGINT) AS "end"
FROM best JOIN n USING (license) JOIN d USING (r) WHERE x.c >= {MIN_CONTAINMENT} * n.n - 1e-9
"""


ORACLE = oracle()
