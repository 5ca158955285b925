"""License scan: normalised text against licence templates by the Dice coefficient over word bigrams, in
DataFrame functions only.

Text is lower-cased (A-Z) and cut into words of letters and digits. A unit is a line, a paragraph (between
blank lines), the whole text, or a run of neighbouring lines, over blank ones too, of up to (2-t)/t times the
template's words at threshold t. A text is looked at if it holds one of a few long words, of which any match with
some template must hold one (``probes``). Each unit is compared to every template whose size allows the threshold at all:
with sets of a and b bigrams Dice is at most 2*min(a,b)/(a+b). Units that share no bigram with any template
are left out first. Runs are formed only for templates of which the text holds t/(2-t) of the bigrams, without
which no part of it can reach t, and from and to lines with bigrams of the template: others only lower Dice.

Defined results: null text, or text without words, matches nothing; equal scores go to the name that sorts
first; a unit of one word has the word itself as its only member. Repeated rows stay repeated; input columns
with the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words that say little of a licence; they only come last where words to look for are chosen.
PLAIN = {"0", "1", "2", "3", "4", "a", "all", "and", "any", "as", "by", "following", "for", "in", "is", "it", "of", "or", "possible", "provided", "public", "published", "received", "source", "subject", "that", "the", "this", "to", "under", "with", "work", "you"}

#: Public licence notices and short licences by SPDX-like name: fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "all-rights-reserved": "All rights reserved.",
}


def words_of(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a template, sorted."""
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} or set(words))


def probes(table: dict[str, list[str]], threshold: float) -> list[str]:
    """Words of which every match holds one. A match lacks at most (2-2t)/(2-t) of a template's bigrams, so for each
    template more bigrams than that hold one of these words; long words come first, those that any prose holds last."""
    chosen: set[str] = set()
    for grams in table.values():
        spare = len(grams) * (1 - threshold / (2 - threshold)) + 1e-9
        held = lambda words: sum(any(w in words for w in g.split()) for g in grams)
        for w in sorted({w for g in grams for w in g.split()}, key=lambda w: (w in PLAIN, -len(w), w)):
            if held(chosen) > spare:
                break
            chosen.add(w)
    # a word that holds another one as a part says no more than that
    return sorted(w for w in chosen if not any(len(v) > 3 and v in w for v in chosen - {w}))


def scan_licenses(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with license (the best template, or null), dice, and licenses (every template matched, sorted)."""
    given = TEMPLATES if templates is None else templates
    table = {name: grams for name, t in sorted(given.items()) if (grams := bigrams(t))}
    out = docs.drop("license", "dice", "licenses", "_units", "_found")
    if not table:
        return out.withColumns({"license": F.lit(None).cast("string"), "dice": F.lit(0.0), "licenses": F.array().cast("array<string>")})
    literal = "array(" + ", ".join(f"named_struct('name', '{n}', 'grams', array({', '.join(repr(g) for g in grams)}), 'size', {len(grams)}, 'words', {len(words_of(given[n]))})" for n, grams in table.items()) + ")"
    every = "array(" + ", ".join(repr(g) for g in sorted({g for grams in table.values() for g in grams})) + ")"
    least, most = (f(len(g) for g in table.values()) for f in (min, max))
    low, high = threshold / (2 - threshold) * least, (2 - threshold) / threshold * most

    def words(c: str) -> str:
        return f"filter(split(translate({c}, '{UPPER}', '{LOWER}'), '[^0-9a-z]+'), w -> w != '')"

    def grams_of(w: str) -> str:
        return f"CASE WHEN size({w}) < 2 THEN {w} ELSE array_distinct(transform(slice({w}, 1, size({w}) - 1), (x, i) -> concat(x, ' ', {w}[i + 1]))) END"

    grams = grams_of("w")
    units = r"filter(array_distinct(concat(split(_t, '\n'), split(_t, '\n[\\x20\\x09-\\x0D]*\n'), array(_t))), u -> u rlike '[0-9A-Za-z]')"
    looked = probes(table, threshold)
    possible = " OR ".join(f"contains(_t, '{w}')" for w in looked if len(w) > 3)
    if short := [w for w in looked if len(w) <= 3]:
        possible += f"{' OR ' * bool(possible)}_t rlike '(^|[^0-9a-z])({'|'.join(short)})([^0-9a-z]|$)'"
    out = out.withColumn("_t", F.lower(F.coalesce(F.col(text), F.lit("")))).withColumn("_t", F.expr(f"CASE WHEN {possible} THEN {{text}} ELSE '' END".format(text=f"`{text}`")))
    out = out.withColumn("_u", F.expr(units))
    out = out.withColumn("_w", F.expr(f"transform(_u, u -> {words('u')})"))
    out = out.withColumn("_g", F.expr(f"filter(transform(_w, w -> {grams}), g -> size(g) BETWEEN {low - 1e-9} AND {high + 1e-9} AND arrays_overlap(g, {every}))"))
    dice = "2.0D * size(array_intersect(g, x.grams)) / (size(g) + x.size)"
    bound = f"2.0D * least(size(g), x.size) >= {threshold} * (size(g) + x.size)"
    out = out.withColumn("_found", F.expr(f"flatten(transform(_g, g -> filter(transform(filter({literal}, x -> {bound}), x -> named_struct('d', {dice}, 'name', x.name)), m -> m.d >= {threshold})))"))
    out = out.withColumn("_found", F.concat("_found", F.expr(_runs(words, grams_of, literal, every, threshold))))
    # a generator of one row: filters on results stay above it, so nothing is looked at twice
    out = out.withColumn("_found", F.explode(F.array("_found")))
    best = "array_sort(_found, (a, b) -> CASE WHEN a.d > b.d THEN -1 WHEN a.d < b.d THEN 1 WHEN a.name < b.name THEN -1 WHEN a.name > b.name THEN 1 ELSE 0 END)"
    out = out.withColumn("_best", F.expr(f"get({best}, 0)"))
    return out.withColumns({
        "license": F.col("_best.name"),
        "dice": F.coalesce("_best.d", F.lit(0.0)),
        "licenses": F.expr("array_sort(array_distinct(transform(_found, m -> m.name)))"),
    }).drop("_t", "_u", "_w", "_g", "_found", "_best")


def _runs(words: Callable[[str], str], grams_of: Callable[[str], str], literal: str, every: str, threshold: float) -> str:
    """SQL for the matches of runs of lines in _t: array of (d, name)."""

    def let(name: str, value: str, body: str) -> str:
        return f"transform(array({value}), {name} -> {body})[0]"

    share = threshold / (2 - threshold)
    members = every.removeprefix("array")
    # the templates of which the text holds enough; the one look at all of its words, and hashed
    whole = let("w", words("_t"), f"filter(concat(w, {grams_of('w')}), y -> y IN {members})")
    near = f"filter({literal}, z -> size(array_intersect(s, z.grams)) >= {share} * z.size - 1e-9)"
    near = let("s", whole, near)
    lines = f"filter(transform(split(_t, '\\n'), c -> {words('c')}), l -> size(l) > 0)"
    ends = "aggregate(n, array(0), (a, l) -> concat(a, array(element_at(a, -1) + size(l))))"
    # a line with the words on both sides of it, as bigrams go over its ends
    round_ = "concat(CASE WHEN j > 0 THEN slice(n[j - 1], -1, 1) ELSE array() END, n[j], CASE WHEN j + 1 < size(n) THEN slice(n[j + 1], 1, 1) ELSE array() END)"
    hits = f"filter(sequence(0, size(n) - 1), j -> arrays_overlap({let('r', round_, f'concat(r, {grams_of("r")})')}, z.grams))"
    spans = f"filter(h, j -> j > i AND e[j + 1] - e[i] BETWEEN {share} * z.size - 1e-9 AND z.words / {share} + 1e-9)"
    run = "flatten(slice(n, i + 1, j - i + 1))"
    dice = let("v", run, let("q", grams_of("v"), "2.0D * size(array_intersect(q, z.grams)) / (size(q) + z.size)"))
    found = f"flatten(transform(h, i -> transform({spans}, j -> named_struct('d', {dice}, 'name', z.name))))"
    found = let("n", lines, let("e", ends, f"flatten(transform(m, z -> {let('h', hits, found)}))"))
    found = f"CASE WHEN size(m) > 0 THEN filter({found}, y -> y.d >= {threshold}) END"
    return f"coalesce({let('m', near, found)}, array())"


def oracle() -> str:
    """DuckDB SQL for op10."""
    rows = ", ".join(f"('{n}', [{', '.join(repr(g) for g in bigrams(t))}])" for n, t in sorted(TEMPLATES.items()))
    return rf"""
WITH x AS (SELECT * FROM (VALUES {rows}) v(name, xg)),
u AS (
  SELECT doc_id, unnest(list_distinct(list_concat(string_split(t, chr(10)), regexp_split_to_array(t, '\n[\x20\x09-\x0D]*\n'), [t]))) AS u
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(u, '{UPPER}', '{LOWER}'), '[^0-9a-z]+'), lambda s: s <> '') AS w FROM u),
g AS (
  SELECT doc_id, CASE WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM w WHERE len(w) > 0),
m AS (
  SELECT doc_id, name, 2.0::DOUBLE * len(list_intersect(g, xg)) / (len(g) + len(xg)) AS d FROM g, x
  WHERE len(g) BETWEEN {THRESHOLD / (2 - THRESHOLD)} * len(xg) - 0.001 AND {(2 - THRESHOLD) / THRESHOLD} * len(xg) + 0.001),
r AS (SELECT doc_id, name, max(d) AS d FROM m WHERE d >= {THRESHOLD} GROUP BY doc_id, name),
b AS (
  SELECT doc_id, arg_max(name, d) FILTER (WHERE k = 1) AS license, max(d) AS dice, string_agg(name, ',' ORDER BY name COLLATE "C") AS licenses
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d DESC, name COLLATE "C") AS k FROM r) GROUP BY doc_id)
SELECT doc_id, license, coalesce(dice, 0.0) AS dice, coalesce(licenses, '') AS licenses
FROM documents LEFT JOIN b USING (doc_id)"""
