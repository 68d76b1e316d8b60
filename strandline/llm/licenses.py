"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

The main path is built-in DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache, reduce
from importlib.resources import files
from math import ceil
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import materialize

SHINGLE = 5
CONTAINMENT = 0.8
#: Bits of a shingle's hash that name its band: a band holds the smallest hash of its own part of
#: the hash space, one hash function for all bands. See WindowClass for the collision probability.
BAND_BITS = 7
#: Rows and shingles of a library up to which it may be broadcast; a larger one is joined by exchange.
BROADCAST_SHINGLES = 200_000

#: Short public notices, in their usual wording.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-3.0-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "bsd-3-clause-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not "
    "use this file except in compliance with the License. You may obtain a copy of the "
    "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or "
    "agreed to in writing, software distributed under the License is distributed on an AS IS "
    "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the "
    "License for the specific language governing permissions and limitations under the License.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under "
    "the terms of the GNU General Public License as published by the Free Software Foundation; "
    "either version 2 of the License, or (at your option) any later version.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under "
    "the terms of the GNU Affero General Public License as published by the Free Software "
    "Foundation, either version 3 of the License, or (at your option) any later version.",
}

_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR "
    "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
    "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are "
    "permitted provided that the following conditions are met: 1. Redistributions of source "
    "code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. "
)
#: Whole texts that are short; those of several pages are files beside this module.
SHORT_TEXTS = {
    "mit-text": "Permission is hereby granted, free of charge, "
    "to any person obtaining a copy of this "
    "software and associated documentation files "
    "(the Software), to deal in the Software "
    "without restriction, including without "
    "limitation the rights to use, copy, modify, "
    "merge, publish, distribute, sublicense, and/or "
    "sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to "
    "do so, subject to the following conditions: "
    "The above copyright notice and this permission "
    "notice shall be included in all copies or "
    "substantial portions of the Software. THE "
    "SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY "
    "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
    "NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR "
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
    "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
    "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
    "SOFTWARE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any "
    "purpose with or without fee is hereby granted, provided that the above copyright "
    "notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS "
    "IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
    "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
    "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
    "THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-clause-text": _BSD + _AS_IS,
    "bsd-3-clause-text": _BSD + "3. " + NOTICES["bsd-3-clause-endorse"] + " " + _AS_IS,
    "zlib-text": "This software is provided as-is, without any express or implied warranty. In no "
    "event will the authors be held liable for any damages arising from the use of this "
    "software. Permission is granted to anyone to use this software for any purpose, including "
    "commercial applications, and to alter it and redistribute it freely, subject to the "
    "following restrictions: 1. The origin of this software must not be misrepresented; you must "
    "not claim that you wrote the original software. If you use this software in a product, an "
    "acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be "
    "misrepresented as being the original software. 3. This notice may not be removed or "
    "altered from any source distribution.",
}


@cache
def library() -> dict[str, str]:
    """Name -> text of every notice, short text and file of license_texts."""
    long = {f"{f.name.removesuffix('.txt')}-text": f.read_text() for f in files("strandline.llm").joinpath("license_texts").iterdir() if f.name.endswith(".txt")}
    return NOTICES | SHORT_TEXTS | long


def word_list(text: Column) -> Column:
    """Runs of letters and digits of a whole lower-cased text, in order."""
    return F.array_remove(F.split(text, r"[^\p{L}\p{N}]+"), "")


def template_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def template_shingles(text: str) -> list[tuple[str, ...]]:
    words = template_words(text)
    return sorted({tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)})


def anchors(shingles: dict[str, list[tuple[str, ...]]], containment: float = CONTAINMENT) -> list[str]:
    """Words of which every text that holds a template at the containment has one, by the pigeonhole principle.

    So many of a template's shingles hold an anchor that the rest are too few for a
    match. Chosen greedily, the word first that stands in most shingles still wanted;
    short words only where nothing else is left.
    """
    wanted = {n: len(s) - ceil(round(containment * len(s), 9)) + 1 for n, s in shingles.items()}
    left, picked = {n: set(s) for n, s in shingles.items()}, []
    while any(w > 0 for w in wanted.values()):
        votes: dict[str, int] = {}
        for name, own in left.items():
            if wanted[name] > 0:
                count: dict[str, int] = {}
                for s in own:
                    for w in set(s):
                        count[w] = count.get(w, 0) + 1
                for w, n in count.items():
                    votes[w] = votes.get(w, 0) + min(n, wanted[name])
        best = min(votes, key=lambda w: (len(w) < 7 or not w.isalpha(), -votes[w], w))
        picked.append(best)
        for name, own in left.items():
            gone = {s for s in own if best in s}
            wanted[name] -= len(gone)
            left[name] = own - gone
    return sorted(picked)


def _once(value: Column) -> Column:
    """A value behind a generator, so that no later use evaluates its expression again."""
    return F.explode(F.array(value))


@dataclass(frozen=True)
class WindowClass:
    """Windows for templates of some number of shingles.

    A template of up to four shingles must be held whole, so its windows are of its
    size at every place: equal sets, which agree in every band. Above that, windows
    serve templates of more than most / 2 and up to most shingles; they have
    1.5 * most + 1 places and start every half of most, so each run of most places
    lies whole in one. A template of s shingles contained at c shares at least c * s
    of at most 1.5 * most + 1 + (1 - c) * s shingles with it, a similarity of 0.24
    or more. A shared shingle is no band's minimum only if a smaller hash falls
    into its band; with 2 ** BAND_BITS bands, all of them miss with probability
    under 1e-5 for each class.
    """

    most: int

    @property
    def stride(self) -> int:
        return 1 if self.most <= 4 else self.most // 2

    @property
    def length(self) -> int:
        return self.most if self.most <= 4 else self.most + self.stride + 1

    def least_shared(self, containment: float = CONTAINMENT) -> int:
        """Shingles that a match of the smallest template of the class shares."""
        if self.most <= 4:
            return self.most
        smallest = self.most // 2 + 1 if self.most > 8 else next(s for s in range(1, 9) if class_of(s, containment).most == 8)
        return ceil(round(containment * smallest, 9))

    def least_similarity(self, containment: float = CONTAINMENT) -> float:
        if self.most <= 4:
            return 1.0
        return self.least_shared(containment) / (self.length + (1 - containment) * (self.most // 2 + 1))


def class_of(shingles: int, containment: float = CONTAINMENT) -> WindowClass:
    if shingles <= 4 and ceil(round(containment * shingles, 9)) == shingles:
        return WindowClass(shingles)
    most = 8
    while most < shingles:
        most *= 2
    return WindowClass(most)


def _band_minima(hashes: Column) -> Column:
    """The smallest hash of each band that a set of shingle hashes reaches; hashes must be sorted."""
    band = lambda h: F.shiftright(h, 64 - BAND_BITS)
    return F.filter(hashes, lambda h, i: (i == 0) | (band(h) != band(F.get(hashes, i - 1))))


def _library(spark: SparkSession, shingles: dict[str, list[tuple[str, ...]]], containment: float) -> tuple[DataFrame, DataFrame]:
    """((most, value, license), (license, most, shingles)): bands and texts of the templates."""
    rows = [(n, class_of(len(s), containment).most, [list(x) for x in s]) for n, s in sorted(shingles.items())]
    base = spark.createDataFrame(rows, "license string, most int, shingles array<array<string>>")
    hashed = base.select("license", "most", F.sort_array(F.transform("shingles", lambda s: F.xxhash64(s))).alias("h"))
    bands = hashed.select("most", F.explode(_band_minima(F.col("h"))).alias("value"), "license")
    return bands, base.select("license", F.transform("shingles", lambda s: F.concat_ws(" ", s)).alias("shingles"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, containment, n_windows, first_word): the templates that texts contain.

    A window matches a template if it holds at least the given share of the
    template's distinct five-word shingles; containment is the best over windows,
    n_windows counts matching windows, first_word is the smallest place (from 0)
    of a matching window's first template shingle. All windows of every text with
    an anchor word are banded; the bands they share with templates are the only
    candidates, and their words are compared exactly. Templates of fewer than five
    words never match. Null, empty and short texts give no row. Rows that repeat a
    doc_id merge; extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    named = {n: template_shingles(t) for n, t in (library() if templates is None else templates).items()}
    named = {n: s for n, s in named.items() if s}
    if not named:
        return spark.createDataFrame([], "doc_id long, license string, containment double, n_windows long, first_word int")
    likely = reduce(or_, [F.contains(F.col("low"), F.lit(w)) for w in anchors(named, containment)])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _once(F.lower(F.col("text").cast("string"))).alias("low")).filter(likely)
    words = texts.select("doc_id", _once(word_list(F.col("low"))).alias("words")).filter(F.size("words") >= SHINGLE)
    kept = materialize(words.select("doc_id", F.xxhash64("words").alias("key"), "words"), "license-texts")
    every = F.transform(F.sequence(F.lit(1), F.size("words") - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice("words", i, SHINGLE)))
    hashed = kept.select("doc_id", "key", _once(every).alias("h"))
    classes = [WindowClass(m) for m in sorted({class_of(len(s), containment).most for s in named.values()})]

    def windows(c: WindowClass) -> Column:
        # a window of fewer places than the least share of the class's smallest template cannot match
        room = F.size("h") - c.least_shared(containment)
        starts = F.when(room >= 0, F.transform(F.sequence(F.lit(0), F.floor(room / c.stride).cast("int")), lambda k: k * c.stride)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda a: F.struct(F.lit(c.most).alias("most"), a.alias("start"), F.sort_array(F.slice("h", a + 1, c.length)).alias("own")))

    cut = hashed.select("doc_id", "key", F.explode(F.concat(*[windows(c) for c in classes])).alias("w"))
    banded = cut.select("doc_id", "key", "w.most", "w.start", F.explode(_band_minima(F.col("w.own"))).alias("value"))
    bands, exact = _library(spark, named, containment)
    small = F.broadcast if sum(map(len, named.values())) <= BROADCAST_SHINGLES else lambda d: d
    found = banded.join(small(bands), ["most", "value"]).select("doc_id", "key", "most", "start", "license").distinct()
    length = F.create_map(*[F.lit(x) for c in classes for x in (c.most, c.length)])
    spans = F.slice("words", F.col("start") + 1, F.element_at(length, F.col("most")) + (SHINGLE - 1))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("key"))
    pairs = found.withColumnsRenamed({"doc_id": "id", "key": "k"}).join(kept, same).select("doc_id", "license", "start", _once(spans).alias("own"))
    own = F.transform(F.sequence(F.lit(1), F.size("own") - (SHINGLE - 1)), lambda i: F.concat_ws(" ", F.slice("own", i, SHINGLE)))
    shingled = pairs.select("doc_id", "license", "start", _once(own).alias("own")).join(small(exact), "license")
    shared = shingled.select("doc_id", "license", "start", "own", F.size("shingles").alias("size"), _once(F.array_intersect("own", "shingles")).alias("shared"))
    matched = shared.filter(F.size("shared") / F.col("size") >= containment).select(
        "doc_id", "license", "start", (F.size("shared") / F.col("size")).alias("containment"),
        (F.col("start") + F.array_position("own", F.col("shared")[0]).cast("int") - 1).alias("place"),
    )
    return matched.groupBy("doc_id", "license").agg(
        F.round(F.max("containment"), 6).alias("containment"), F.countDistinct("start").alias("n_windows"), F.min("place").alias("first_word")
    )


def oracle(templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> str:
    """The same result in DuckDB SQL from every shingle of every text, without retrieval."""
    rows = []
    for name, text in sorted((library() if templates is None else templates).items()):
        if n := len(template_shingles(text)):
            c = class_of(n, containment)
            rows.append(f"('{name}', {n}, {c.stride}, {c.length}, '{' '.join(template_words(text))}')")
    return f"""
WITH l(license, size, stride, len, words) AS (SELECT n, size, stride, len, string_split(words, ' ') FROM (VALUES {", ".join(rows)}) v(n, size, stride, len, words)),
t AS (SELECT DISTINCT license, size, stride, len, array_to_string(words[i + 1 : i + {SHINGLE}], ' ') AS shingle
      FROM (SELECT *, unnest(range(0, len(words) - {SHINGLE - 1})) AS i FROM l)),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, i AS pos, array_to_string(words[i + 1 : i + {SHINGLE}], ' ') AS shingle
      FROM (SELECT doc_id, words, unnest(range(0, len(words) - {SHINGLE - 1})) AS i FROM w WHERE len(words) >= {SHINGLE})),
h AS (SELECT s.doc_id, s.pos, t.* FROM s JOIN t USING (shingle)),
k AS (SELECT *, unnest(range(CAST(greatest(0, ceil((pos - len + 1) / stride)) AS BIGINT), CAST(floor(pos / stride) AS BIGINT) + 1)) AS win FROM h),
c AS (SELECT doc_id, license, win, count(DISTINCT shingle) / any_value(size) AS containment, min(pos) AS place FROM k GROUP BY ALL)
SELECT doc_id, license, round(max(containment), 6) AS containment, count(DISTINCT win) AS n_windows, CAST(min(place) AS INTEGER) AS first_word
FROM c WHERE containment >= {containment} GROUP BY doc_id, license
"""
