"""Licence scans: Dice coefficient over word bigrams, in DataFrame functions alone.

Texts and templates are normalised to words of a-z and 0-9. A text's units are the whole text, its
paragraphs (between blank lines), its lines, and, if asked for, windows as long as a template, laid where a
word of the template that is telling for it (``window_marks``) stands in the text as it does in
the template; so a notice within a longer line, or a licence of several paragraphs within a
longer text, is a unit too. Two sets of bigrams of sizes a (of the unit) and b reach a Dice
coefficient t only if

* ``t / (2 - t) <= a / b <= (2 - t) / t``, where a is less than the unit's words, so that a unit
  too short for every template is passed over before a bigram is made, and others meet only
  the templates of their size, and
* the unit has at least ``b t / (2 - t)`` of the template's bigrams, so one of any choice of more
  than the rest. ``anchor_words`` are words whose bigrams are that many in every template: a
  text without any of them is passed over after one look at its words.

Everything is computed within a row; only hits are shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_DICE = 0.8
#: Words of a template by which windows are laid.
MARKS = 3
#: Words that are anchors only where no other will do.
COMMON = frozenset("a an and any are as at be by can for from has have if in is it its may not of on one or shall so that the their then these this to under was which who whom with you your".split())

# Customary licence notices and short licence texts, by SPDX identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]


def template_words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def template_bigrams(templates: list[tuple[str, str]] = TEMPLATES) -> list[tuple[str, list[str]]]:
    """(licence, distinct bigrams) of each template that has a bigram."""
    made = []
    for name, text in templates:
        words = template_words(text)
        if bigrams := sorted({f"{a} {b}" for a, b in zip(words, words[1:])}):
            made.append((name, bigrams))
    return made


def window_marks(templates: list[tuple[str, str]] = TEMPLATES) -> list[tuple[str, int, int]]:
    """(word, how many words of the template stand before it, the template's length): for each third
    of a template its rarest word, in the template and then among all, common ones last."""
    every = [template_words(text) for _, text in templates]
    among = Counter(w for words in every for w in set(words))
    marks = set()
    for words in every:
        own = Counter(words)
        for part in range(MARKS):
            span = range(len(words) * part // MARKS, len(words) * (part + 1) // MARKS)
            if span:
                at = min(span, key=lambda i: (words[i] in COMMON, own[words[i]], among[words[i]], i))
                marks.add((words[at], at, len(words)))
    return sorted(marks)


def _bounds(size: int, least: float) -> tuple[float, float]:
    return size * least / (2 - least), size * (2 - least) / least


def anchor_words(grams: list[tuple[str, list[str]]], least: float = LEAST_DICE) -> list[str]:
    """Words of which every unit that reaches ``least`` for some template has one: taken
    greedily by the number of bigrams still lacking that they cover, common words last."""
    spare = [len(b) - math.ceil(len(b) * least / (2 - least) - 1e-9) for _, b in grams]
    covered: list[set[str]] = [set() for _ in grams]
    chosen: list[str] = []
    while open_ := [i for i, c in enumerate(covered) if len(c) <= spare[i]]:
        gains: Counter = Counter()
        for i in open_:
            for bigram in set(grams[i][1]) - covered[i]:
                gains.update({w: 1 for w in bigram.split()})
        word = max(gains, key=lambda w: (w not in COMMON, gains[w], w))
        chosen.append(word)
        for i, (_, own) in enumerate(grams):
            covered[i] |= {b for b in own if word in b.split()}
    return chosen


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text, "[^a-z0-9]+", " ")), " ")


def marked(words: Column, templates: list[tuple[str, str]]) -> Column:
    """The words by which windows are laid, as structs of ``w`` and the place ``i`` from 1."""
    telling = F.array(*map(F.lit, sorted({w for w, _, _ in window_marks(templates)})))
    placed = F.transform(words, lambda w, i: F.when(F.array_contains(telling, w), F.struct(w.alias("w"), (i + 1).alias("i"))))
    return F.filter(placed, lambda x: x.isNotNull())


def units(low: Column, words: Column, found: Column | None, templates: list[tuple[str, str]]) -> Column:
    """The units of a lower-cased text with these words, of which ``found`` are marked, as structs of
    ``words`` and ``window``. Arguments are used often, so they should be columns."""
    marks = window_marks(templates)

    def windows(mark: str, before: int, length: int) -> Column:
        first = lambda x: F.greatest(F.lit(1), x["i"] - before)
        return F.transform(F.filter(found, lambda x: x["w"] == mark), lambda x: F.slice(words, first(x), x["i"] - before + length - first(x)))

    split = F.concat(F.split(low, r"\r?\n[ \t]*\r?\n"), F.split(low, r"\r?\n"))
    plain = F.array_distinct(F.concat(F.array(words), F.transform(split, _words)))
    if found is None:
        return F.transform(plain, lambda u: F.struct(u.alias("words"), F.lit(False).alias("window")))
    laid = F.array_distinct(F.flatten(F.array(*(windows(*m) for m in marks))))
    told = lambda units, window: F.transform(units, lambda u: F.struct(u.alias("words"), F.lit(window).alias("window")))
    return F.concat(told(plain, False), told(laid, True))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST_DICE, windows: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` -> one row for each document and licence found in it: ``doc_id,
    license, dice`` (of the best unit) and ``n_units``, how many distinct lines, paragraphs or whole
    texts match (0 if just a window does). A unit counts for its best licence alone, the
    alphabetically last on a tie.

    Null and empty texts hold no licence; rows without an id are left out; repeated rows of one
    id count as one document; further columns are ignored; an empty table gives an empty
    result.
    """
    grams = template_bigrams(templates)
    low = [_bounds(len(b), least) for _, b in grams]
    fewest, most = min(a for a, _ in low), max(b for _, b in low)
    anchors = F.array(*map(F.lit, anchor_words(grams, least)))
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.lower("text").alias("low"))
    # An explode of one element keeps an expression that is used often from being copied.
    worded = rows.select("doc_id", "low", F.explode(F.array(_words(F.col("low")))).alias("all")).where(F.arrays_overlap("all", anchors))
    if windows:
        worded = worded.select("doc_id", "low", "all", F.explode(F.array(marked(F.col("all"), templates))).alias("found"))
    cut = worded.select("doc_id", F.explode(units(F.col("low"), F.col("all"), F.col("found") if windows else None, templates)).alias("u")).select("doc_id", "u.words", "u.window")
    n = F.size("words")
    bigrams = F.zip_with(F.slice("words", F.lit(1), n - 1), F.slice("words", F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    long_enough = cut.where((n - 1 >= F.lit(fewest)) & F.arrays_overlap("words", anchors))
    sized = long_enough.select("doc_id", F.when(~F.col("window"), F.col("words")).alias("unit"), F.explode(F.array(F.array_distinct(bigrams))).alias("bigrams"))
    size = F.size("bigrams")
    sized = sized.where(size <= F.lit(most))
    found = F.array(
        *(
            F.when(
                size.between(a, b),
                F.struct((F.lit(2.0) * F.size(F.array_intersect("bigrams", F.array(*map(F.lit, own)))) / (size + len(own))).alias("dice"), F.lit(name).alias("license")),
            )
            for (name, own), (a, b) in zip(grams, low)
        )
    )
    hits = sized.select("doc_id", "unit", F.explode(F.array(F.array_max(found))).alias("f")).where(F.col("f.dice") >= least)
    return hits.groupBy("doc_id", F.col("f.license").alias("license")).agg(F.round(F.max("f.dice"), 6).alias("dice"), F.count_distinct("unit").alias("n_units"))


def scan_sql(templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST_DICE, windows: bool = False) -> str:
    """The same scan as DuckDB SQL over ``documents``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    laid = "\n    UNION ALL SELECT doc_id, w[greatest(1, i - ahead) : i - ahead + length - 1], false FROM spot JOIN mark USING (word) JOIN low USING (r)" if windows else ""
    words = lambda x: f"string_split(trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g')), ' ')"
    marks = ", ".join(f"({quote(w)}, {before}, {length})" for w, before, length in window_marks(templates))
    values = ", ".join(f"({quote(name)}, [{', '.join(map(quote, own))}])" for name, own in template_bigrams(templates))
    return f"""
WITH tpl(license, own) AS (VALUES {values}),
low AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, lower(text) AS t, {words('lower(text)')} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
mark(word, ahead, length) AS (VALUES {marks}),
spot AS (SELECT r, i, w[i] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM low)),
worded AS (
  SELECT DISTINCT doc_id, CASE WHEN plain THEN w END AS unit, w FROM (
    SELECT doc_id, w, true AS plain FROM low
    UNION ALL SELECT doc_id, {words("unnest(regexp_split_to_array(t, '\\r?\\n[ \\t]*\\r?\\n'))")}, true FROM low
    UNION ALL SELECT doc_id, {words("unnest(regexp_split_to_array(t, '\\r?\\n'))")}, true FROM low{laid})),
grams AS (
  SELECT doc_id, unit, w, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b
  FROM worded WHERE len(w) >= 2),
scored AS (
  SELECT doc_id, unit, w, license, 2.0 * len(list_intersect(b, own)) / (len(b) + len(own)) AS dice
  FROM grams, tpl WHERE len(b) BETWEEN len(own) * {least} / (2 - {least}) AND len(own) * (2 - {least}) / {least})
SELECT doc_id, license, round(max(dice), 6) AS dice, count(DISTINCT unit) AS n_units FROM (
  SELECT * FROM scored WHERE dice >= {least}
  QUALIFY row_number() OVER (PARTITION BY doc_id, unit, w ORDER BY dice DESC, license DESC) = 1)
GROUP BY doc_id, license"""
