"""Licence scans, in SQL expressions only.

Every line of a text, and every paragraph of several lines (cut at blank lines), is normalised to
lower-case ASCII words and compared with licence templates by the Dice coefficient of their sets of word bigrams:
2 * common / (bigrams + bigrams of the template). It matches from ``threshold`` on. As the
coefficient is at most 2 * min / (min + max) of the two sizes, only templates whose size is within
threshold / (2 - threshold) of the unit's, either way, are compared. A unit that matches also shares
that part of the template's bigrams, so each template has a few words of which it must hold one;
texts and units with no such word of any template are not taken apart into bigrams. Notices of some licences are much alike (those of
the GPL and the LGPL, say): where a unit matches templates that are kin, the one counts of which it has most bigrams, less those of the template that it lacks.

``within`` also looks inside the units, for templates that the whole unit does not match: a run of words,
of at most twice the template's bigrams, that reaches the threshold makes the unit match. A run of a paragraph counts if it spans a line
end and no run of that template within one of the paragraph's lines is as good. Only units with the part of the template's
bigrams that a match needs are searched.

Defined cases: a null text counts as empty and matches nothing; units of fewer than two words have
no bigrams and match nothing; every row gives one row, repeated rows alike; doc_id may be null; of
templates of equal coefficient the first by name is the best; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

THRESHOLD = 0.8
#: Templates of two licences that share this part of the smaller one's bigrams are kin.
KIN = 0.75
COMMON = frozenset("a an and as at by for in is it of on or the this to with".split())

# Public licence texts and notices, by SPDX name. Short licences are given whole, by paragraph; long ones by the
# notices that they ask for, their titles and telling paragraphs. What BSD-2-Clause and BSD-3-Clause share stands under the former.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_FREE = (
    "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published "
    "by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
)
_OLD_FREE = (
    "{0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published "
    "by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."
)
_NO_WARRANTY = (
    "{0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
    "FOR A PARTICULAR PURPOSE. See the GNU {1} for more details."
)
TEMPLATES = {
    "0BSD": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "Licensed under the Zero-Clause BSD License.",
    ],
    "AGPL-3.0": [
        "GNU Affero General Public License Version 3, 19 November 2007",
        _FREE.format("This program", "Affero General Public License", 3),
        _NO_WARRANTY.format("This program", "Affero General Public License"),
        "This work is licensed under the GNU Affero General Public License, version 3.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
        "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, "
        "non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, "
        "sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "Artistic-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This license establishes the terms under "
        "which a given free software Package may be copied, modified, distributed, and/or redistributed.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
        "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
        "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
        "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Licensed under the BSD 2-Clause License.",
    ],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.",
        "Licensed under the BSD 3-Clause License.",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Boost Software License - Version 1.0 - August 17th, 2003",
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license '
        '(the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit '
        "third-parties to whom the Software is furnished to do so, all subject to the following:",
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included "
        "in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of "
        "machine-executable object code generated by a source language processor.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": [
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. "
        "This software is distributed without any warranty.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Creative Commons Legal Code CC0 1.0 Universal",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0",
        'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM '
        "CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",
    ],
    "GPL-2.0": [
        "GNU General Public License Version 2, June 1991",
        _OLD_FREE.format("This program", "General Public License", 2),
        "This work is licensed under the GNU General Public License, version 2.",
    ],
    "GPL-3.0": [
        "GNU General Public License Version 3, 29 June 2007",
        "This work is licensed under the GNU General Public License, version 3.",
        _FREE.format("This program", "General Public License", 3),
        _NO_WARRANTY.format("This program", "General Public License"),
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "LGPL-2.1": [
        "GNU Lesser General Public License Version 2.1, February 1999",
        _OLD_FREE.format("This library", "Lesser General Public License", "2.1"),
        _NO_WARRANTY.format("This library", "Lesser General Public License"),
    ],
    "LGPL-3.0": [
        "GNU Lesser General Public License Version 3, 29 June 2007",
        _FREE.format("This library", "Lesser General Public License", 3),
        "This work is licensed under the GNU Lesser General Public License, version 3.",
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        _AS_IS,
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
    ],
    "NCSA": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers.",
    ],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "PostgreSQL": [
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, "
        "provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
        "relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ],
    "WTFPL": [
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004",
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "This notice may not be removed or altered from any source distribution.",
    ],
}


def template_rows(templates: dict[str, list[str]] = TEMPLATES) -> list[tuple[str, list[str]]]:
    """(name, distinct bigrams) of every template."""
    out = []
    for name in sorted(templates):
        for text in templates[name]:
            words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
            out.append((name, sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})))
    return out


def kin_names(rows: list[tuple[str, list[str]]]) -> list[list[str]]:
    """Of every template, the names of the others that are much like it, or like a part of it."""
    sets = [set(g) for _, g in rows]
    like = lambda a, b: len(a & b) >= KIN * min(len(a), len(b))
    return [sorted({m for (m, _), b in zip(rows, sets, strict=True) if m != n and like(a, b)}) for (n, _), a in zip(rows, sets, strict=True)]


def needed_words(rows: list[tuple[str, list[str]]], threshold: float = THRESHOLD) -> list[str]:
    """Words, long ones first and common ones last, that cover so many bigrams of each template that a match cannot do without all of them."""
    out: set[str] = set()
    for _, grams in rows:
        spare = len(grams) - math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9)
        covered: set[str] = set()
        for word in sorted({w for g in grams for w in g.split()}, key=lambda w: (w in COMMON, -len(w), w)):
            if len(covered) > spare:
                break
            mine = {g for g in grams if word in g.split()}
            if mine - covered:
                covered |= mine
                out.add(word)
    return sorted(out)


def _breaks(unit: Column) -> Column:
    """Of a paragraph, the places of the bigrams that span a line end; an empty array of a line."""
    sizes = F.transform(F.filter(F.transform(F.split(unit, "\n"), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.size(F.split(x, " ")))
    upto = _bind(sizes, lambda n: F.transform(F.slice(n, 1, F.size(n) - 1), lambda _, k: F.aggregate(F.slice(n, 1, k + 1), F.lit(0), lambda a, x: a + x)))
    return F.when(unit.contains("\n"), upto).otherwise(F.array().cast("array<int>"))


def plain_words(text: Column) -> Column:
    """Lower-case ASCII words and line ends."""
    return F.lower(F.regexp_replace(text, r"[^A-Za-z0-9\n]+", " "))


def units(plain: Column) -> Column:
    """array<string> of normalised lines and paragraphs of several lines; the lines of a paragraph end with a line end."""
    lines = F.split(plain, "\n")
    paragraphs = F.filter(F.split(plain, r"\n(?: ?\n)+"), lambda p: F.trim(p).contains("\n"))
    whole = F.transform(paragraphs, lambda p: F.regexp_replace(p, r" ?\n ?", "\n"))
    return F.filter(F.transform(F.concat(lines, whole), lambda u: F.trim(u)), lambda u: F.trim(F.translate(u, "\n", " ")).contains(" "))


def _bind(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _pairs(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD, within: bool = False) -> DataFrame:
    """doc_id, n_units, n_matches, best (name of the likeliest licence, or null), best_dice, licences (names, sorted).

    ``within``: also the runs of words within each unit."""
    rows = template_rows(templates)
    least = threshold / (2 - threshold)
    known = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(len(g)).alias("n"), F.array(*map(F.lit, g)).alias("grams"), F.array(*map(F.lit, needed_words([(n, g)], threshold))).alias("needed"), F.array(*map(F.lit, k)).cast("array<string>").alias("kin")) for (n, g), k in zip(rows, kin_names(rows), strict=True)])
    low, needed = least * min(len(g) for _, g in rows), F.array(*map(F.lit, needed_words(rows, threshold)))

    def common(grams: Column, t: Column) -> Column:
        return F.size(F.array_intersect(grams, t["grams"]))

    def dice(grams: Column, t: Column, n: Column | None = None) -> Column:
        return (common(grams, t) if n is None else n) * F.lit(2.0) / (F.size(grams) + t["n"])

    def whole(grams: Column) -> Column:
        near = F.filter(known, lambda t: (t["n"] >= F.size(grams) * least) & (F.size(grams) >= t["n"] * least))
        scored = F.transform(near, lambda t: _bind(common(grams, t), lambda n: F.struct(dice(grams, t, n).alias("dice"), t["name"].alias("name"), t["kin"].alias("kin"), (2 * n - t["n"]).alias("more"))))
        return F.filter(scored, lambda s: s["dice"] >= threshold)

    def runs(unit: Column, pairs: Column, t: Column) -> Column:
        """The run of the largest coefficient, or null. The best run starts and ends with a bigram of the template.
        A paragraph's best run must span a line end: else it is one of that line's."""
        at = F.filter(F.sequence(F.lit(1), F.size(pairs)), lambda i: F.array_contains(t["grams"], F.get(pairs, i - 1)))

        def best_of(at: Column, breaks: Column) -> Column:
            def from_start(i: Column) -> Column:
                ends = F.filter(at, lambda j: (j >= i - 1 + t["n"] * least - 1e-9) & (j < i + 2 * t["n"]))
                return F.transform(
                    ends,
                    lambda j: _bind(F.array_distinct(F.slice(pairs, i, j - i + 1)), lambda run: _bind(common(run, t), lambda n: F.struct(
                        dice(run, t, n).alias("dice"),
                        (unit.contains("\n") & ~F.exists(breaks, lambda k: (i <= k) & (k <= j))).alias("in_line"),
                        (2 * n - t["n"]).alias("more"),
                    ))),
                )

            return F.array_max(F.flatten(F.transform(at, from_start)))

        best = _bind(at, lambda at: _bind(_breaks(unit), lambda breaks: best_of(at, breaks)))
        return _bind(best, lambda x: F.when((x["dice"] >= threshold) & ~x["in_line"], x))

    def inside(unit: Column, words: Column, pairs: Column, grams: Column) -> Column:
        """Templates most of whose bigrams the unit has, but that it does not match as a whole."""
        near = F.filter(known, lambda t: (F.size(grams) >= t["n"] * least - 1e-9) & F.arrays_overlap(words, t["needed"]))
        near = F.filter(near, lambda t: (F.size(F.array_intersect(t["grams"], grams)) >= t["n"] * least - 1e-9) & (dice(grams, t) < threshold))
        scored = F.transform(near, lambda t: _bind(runs(unit, pairs, t), lambda r: F.struct(r["dice"].alias("dice"), t["name"].alias("name"), t["kin"].alias("kin"), r["more"].alias("more"))))
        return F.filter(scored, lambda s: s["dice"].isNotNull())

    def matched(unit: Column) -> Column:
        def of_words(words: Column) -> Column:
            def of_pairs(pairs: Column) -> Column:
                return _bind(F.array_distinct(pairs), lambda grams: F.concat(whole(grams), inside(unit, words, pairs, grams)) if within else whole(grams))

            # no fewer words than bigrams + 1: units too short for every template end here
            return F.when((F.size(words) - 1 >= low) & F.arrays_overlap(words, needed), _bind(_pairs(words), of_pairs))

        return _bind(F.split(F.trim(F.translate(unit, "\n", " ")), " "), of_words)

    found = docs.select("doc_id", plain_words(text_of()).alias("plain"))
    # texts without a needed word are told as a whole
    found = found.select("doc_id", units(F.col("plain")).alias("units"), F.arrays_overlap(F.split("plain", "[ \n]"), needed).alias("may"))

    def best_of_kin(m: Column) -> Column:
        return F.filter(m, lambda s: ~F.exists(m, lambda t: (t["more"] > s["more"]) & F.array_contains(s["kin"], t["name"])))

    hits = F.transform(F.filter(F.transform("units", matched), lambda m: m.isNotNull() & (F.size(m) > 0)), best_of_kin)
    none = F.array().cast("array<array<struct<dice:double,name:string,kin:array<string>,more:int>>>")
    found = found.select("doc_id", F.size("units").cast("long").alias("n_units"), F.when(F.col("may"), hits).otherwise(none).alias("m"))
    best = F.array_max(F.transform(F.flatten("m"), lambda s: s["dice"]))
    return found.select(
        "doc_id",
        "n_units",
        F.size("m").cast("long").alias("n_matches"),
        F.array_min(F.transform(F.filter(F.flatten("m"), lambda s: s["dice"] == best), lambda s: s["name"])).alias("best"),
        best.alias("best_dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(F.flatten("m"), lambda s: s["name"]))), ",").alias("licences"),
    )


def oracle() -> str:
    """DuckDB SQL of ``scan`` over documents, without the size bounds."""
    rows, texts = template_rows(), lambda x: "[%s]::VARCHAR[]" % ", ".join(f"'{v}'" for v in x)
    known = ", ".join(f"('{n}', {texts(g)}, {texts(k)})" for (n, g), k in zip(rows, kin_names(rows), strict=True))
    return rf"""
    WITH known(name, grams, kin) AS (VALUES {known}),
    docs AS (SELECT row_number() OVER () AS row_no, doc_id,
        lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9\n]+', ' ', 'g')) AS plain FROM documents),
    pieces AS (
        SELECT row_no, unnest(string_split(plain, chr(10))) AS unit FROM docs
        UNION ALL
        SELECT row_no, regexp_replace(p, '[ \n]+', ' ', 'g') FROM (SELECT row_no, unnest(regexp_split_to_array(plain, '\n(?: ?\n)+')) AS p FROM docs)
        WHERE contains(trim(p, ' '), chr(10))),
    units AS (SELECT row_number() OVER () AS unit_no, row_no, string_split(trim(unit, ' '), ' ') AS w FROM pieces WHERE contains(trim(unit, ' '), ' ')),
    grams AS (SELECT unit_no, row_no, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS g FROM units),
    scored AS (SELECT row_no, unit_no, name, kin, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice, 2 * len(list_intersect(g, grams)) - len(grams) AS more FROM grams, known),
    near AS (SELECT * FROM scored WHERE dice >= {THRESHOLD}),
    hits AS (SELECT * FROM near a WHERE NOT EXISTS (SELECT 1 FROM near b WHERE b.unit_no = a.unit_no AND b.more > a.more AND list_contains(a.kin, b.name))),
    listed AS (SELECT row_no, count(DISTINCT unit_no) AS n_matches, min(name) FILTER (dice = top) AS best, max(dice) AS best_dice,
        string_agg(DISTINCT name, ',' ORDER BY name) AS licences
        FROM (SELECT *, max(dice) OVER (PARTITION BY row_no) AS top FROM hits) GROUP BY row_no)
    SELECT doc_id, coalesce(n, 0) AS n_units, coalesce(n_matches, 0) AS n_matches, best, best_dice, coalesce(licences, '') AS licences
    FROM docs LEFT JOIN (SELECT row_no, count(*) AS n FROM units GROUP BY row_no) USING (row_no) LEFT JOIN listed USING (row_no)"""
