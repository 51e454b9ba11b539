"""License scans: units of a text are compared with licence templates by the Dice coefficient over word bigrams.

A unit is the whole text, a block between blank lines, or a line. Units and templates are normalised alike (ASCII
letters to lower case, runs of anything but ASCII letters and digits to one space) and become sets of word
bigrams. With ``a`` and ``b`` bigrams, Dice is at most ``2 min(a, b) / (a + b)``; so a template can only reach the
threshold ``t`` if ``b t / (2 - t) <= a <= b (2 - t) / t``. A unit's words bound its bigrams from above before the
set is built, the size of the set then prunes templates, and only for the remaining ones bigrams are intersected.

DataFrame functions only: all of it is a narrow pass over the texts; only matches are shuffled.

Nulls and corner cases: null and empty texts have no unit and no row; a unit of fewer than two words has no bigram
and matches nothing; rows that repeat a doc_id count together; an empty table gives an empty result. Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart

THRESHOLD = 0.8

# Short notices and the standard texts or headers of public licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You
should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
# End of fixed values.

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bigrams(text: str) -> list[str]:
    """The template side: its distinct word bigrams."""
    words = re.sub("[^a-z0-9]+", " ", text.translate(str.maketrans(UPPER, LOWER))).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Sizes that a set may have to reach the threshold with a set of n."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def normalised(text: Column) -> Column:
    """Only ASCII is left when letters are changed, which is the fast case of ``lower``."""
    return F.trim(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")))


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, license, dice, template_no, n_units`` for every licence that a unit of the document resembles: the
    best coefficient, the first template that has it, and the number of units at or over the threshold."""
    known = [(no, name, grams, *size_bounds(len(grams), threshold)) for no, (name, text) in enumerate(templates) if (grams := bigrams(text))]
    least = min(k[3] for k in known)
    # bigrams are compared as hashes of hashes of words: numbers are cheaper to build and to compare than strings
    pair = lambda a, b: F.xxhash64(a, b)
    grams_of = lambda grams: F.array(*[pair(*[F.xxhash64(F.lit(w)) for w in g.split()]) for g in grams])
    one = [F.struct(F.lit(no).alias("no"), F.lit(name).alias("name"), grams_of(grams).alias("grams"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for no, name, grams, lo, hi in known]

    none = F.array().cast("array<string>")
    lines = F.when(F.contains("text", F.lit("\n")), F.split("text", "\n")).otherwise(none)
    blocks = F.when(F.col("text").rlike(r"\n[\x20\x09\x0B-\x0D]*\n"), F.split("text", r"\n(?:[\x20\x09\x0B-\x0D]*\n)+")).otherwise(none)
    units = docs.select("doc_id", "text").where("text is not null").select("doc_id", F.explode(F.concat(F.array("text"), lines, blocks)).alias("unit"))
    # each step stands apart, or a filter on its result would compute it a second time
    words = apart(units, w=F.transform(F.split(normalised(F.col("unit")), " "), lambda w: F.xxhash64(w))).where(F.size("w") > least)
    # texts stay out of the lambdas: what a lambda refers to outside may be computed anew for each element
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), pair)
    grams = apart(words.select("doc_id", "w"), grams=F.array_distinct(pairs))
    grams = grams.select("doc_id", "grams", F.size("grams").alias("n")).where(
        " or ".join(f"n between {lo} and {hi}" for lo, hi in sorted({k[3:] for k in known})))

    def score(own: Column, t: Column) -> Column:
        dice = F.lit(2.0) * F.size(F.array_intersect(own, t["grams"])) / (F.size(own) + F.size(t["grams"]))
        return F.struct(t["no"].alias("no"), t["name"].alias("name"), F.when(F.size(own).between(t["lo"], t["hi"]), dice).alias("dice"))

    scored = grams.select("doc_id", F.monotonically_increasing_id().alias("unit_no"), F.explode(F.filter(
        F.zip_with(F.array_repeat("grams", len(one)), F.array(*one), score), lambda s: s["dice"] >= threshold)).alias("m"))
    best = scored.groupBy("doc_id", F.col("m.name").alias("license")).agg(
        F.min(F.struct(-F.col("m.dice"), F.col("m.no"))).alias("best"), F.count_distinct("unit_no").alias("n_units"))
    return best.select("doc_id", "license", (-F.col("best.col1")).alias("dice"), F.col("best.no").cast("long").alias("template_no"), "n_units")


def oracle_license(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same in plain SQL: no size bounds, every unit against every template."""
    rows = ", ".join(f"({no}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for no, (name, text) in enumerate(templates))
    norm = "trim(regexp_replace(translate({0}, '" + UPPER + "', '" + LOWER + "'), '[^a-z0-9]+', ' ', 'g'))"
    return rf"""
WITH templates(no, license, body) AS (VALUES {rows}),
tw AS (SELECT no, license, string_split({norm.format('body')}, ' ') AS w FROM templates),
tg AS (SELECT no, license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM tw),
units AS (
  SELECT doc_id, text AS unit FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, unnest(string_split(text, chr(10))) FROM documents WHERE contains(text, chr(10))
  UNION ALL
  SELECT doc_id, unnest(b) FROM (SELECT doc_id, regexp_split_to_array(text, '\n(?:[\x20\x09\x0B-\x0D]*\n)+') AS b FROM documents) WHERE len(b) > 1),
uw AS (SELECT row_number() OVER () AS unit_no, doc_id, string_split({norm.format('unit')}, ' ') AS w FROM units),
ug AS (SELECT unit_no, doc_id, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM uw),
un AS (SELECT unit_no, doc_id, count(*) AS n FROM ug GROUP BY ALL),
hits AS (
  SELECT u.unit_no, t.no, count(*) AS shared
  FROM ug u JOIN (SELECT no, unnest(g) AS gram FROM tg) t USING (gram) GROUP BY ALL),
scored AS (
  SELECT doc_id, license, unit_no, no, 2.0::DOUBLE * shared / (n + len(g)) AS dice
  FROM hits JOIN un USING (unit_no) JOIN tg USING (no))
SELECT doc_id, license, max(dice) AS dice, CAST(arg_min(no, (-dice, no)) AS BIGINT) AS template_no, count(DISTINCT unit_no) AS n_units
FROM scored WHERE dice >= {threshold} GROUP BY doc_id, license
"""
