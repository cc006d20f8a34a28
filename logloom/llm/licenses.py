"""License scans (operator 2): Dice coefficients over word bigrams against templates, in DataFrame functions only."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .winnow import let

#: Least Dice coefficient of a match.
LEAST = 0.8

#: Complete published wording of licences, a file each (read by the driver only).
TEXTS = Path(__file__).with_name("license_texts")

# Wording of public licences and of the usual one-line notices.
TEMPLATES = {
    "Apache-2.0 (line)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT (line)": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-3-Clause (line)": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "GPL-2.0 (line)": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 (line)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 (notice)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-3.0 (line)": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 (line)": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0 (line)": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-4.0 (line)": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 (line)": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 (line)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 (notice)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
} | {f"{p.stem} (text)": " ".join(p.read_text(encoding="utf-8").split()) for p in sorted(TEXTS.glob("*.txt"))}


def normal_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def bigrams(text: str) -> set[tuple[str, str]]:
    words = normal_words(text)
    return set(zip(words, words[1:], strict=False))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _pairs(words: Column) -> Column:
    """Distinct bigrams of words."""
    both = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))
    return F.array_distinct(both)


#: Words that say little: bigrams and words without them are chosen as anchors first.
COMMON = frozenset("a an and any are as at be by can for from in is it its may no not of on or s such that the this to under with work you your".split())


def needed(size: int, least: float = LEAST) -> int:
    """So many of a template's distinct bigrams that a unit with a coefficient of `least` holds at least one of them.

    With s of the template's m bigrams and n >= s of its own, 2 s / (n + m) >= least needs s >= m * least / (2 - least).
    """
    return min(size, int(size * (1 - least / (2 - least)) + 1e-9) + 1)


def rare_words(text: str, least: float = LEAST) -> list[str]:
    """Words, the longest first, that stand in `needed` of a template's bigrams at least: a unit that matches holds one of them."""
    own = bigrams(text)
    out: list[str] = []
    covered: set[tuple[str, str]] = set()
    for w in sorted(set(normal_words(text)), key=lambda w: (w in COMMON, -len(w), w)):
        if len(covered) >= needed(len(own), least):
            break
        out.append(w)
        covered |= {g for g in own if w in g}
    return out


def anchors(text: str, least: float = LEAST) -> list[tuple[str, int]]:
    """(bigram, place of its first word in the template) of the bigrams with a rare word."""
    words, rare = normal_words(text), set(rare_words(text, least))
    first: dict[str, int] = {}
    for i, (x, y) in enumerate(zip(words, words[1:], strict=False)):
        if x in rare or y in rare:
            first.setdefault(f"{x} {y}", i)
    return list(first.items())


def anchor_words(templates: dict[str, str], least: float = LEAST) -> list[str]:
    """Words of which a text holds one if any unit of it matches."""
    return sorted({w for t in templates.values() for w in rare_words(t, least)})


def _range(values: Column | str, at: Column, length: Column) -> Column:
    """`length` (1 or more) values from the place `at` (from 0, below the end) on, without a copy of all values, which F.slice makes."""
    return F.transform(F.sequence(at, F.least(at + length, F.size(values)) - 1), lambda i: F.get(values, i))


def _best(made: str, width: Column) -> Column:
    """(dice, before: minus the start) of the windows (start, dice) that no better one less than `width` words away displaces.

    Windows of one block of `width` starts are all that near to each other, so a block has one candidate, its best, which is
    compared with the windows of the two blocks beside it: each window is met three times, however many a text has.
    """
    told = lambda x: F.struct(x["dice"].alias("dice"), (-x["start"]).alias("before"))
    block = lambda x: F.floor(x["start"] / width)

    def cut(m: Column) -> Column:
        ends = F.filter(F.transform(m, lambda x, j: F.struct(block(x).alias("block"), j.alias("at"))), lambda e: (e["at"] == 0) | (block(F.get(m, e["at"] - 1)) < e["block"]))
        length = lambda ends, e, k: F.coalesce(F.get(ends, k + 1)["at"], F.size(m)) - e["at"]
        return let(ends, lambda ends: F.transform(ends, lambda e, k: F.struct(e["block"].alias("block"), F.transform(_range(m, e["at"], length(ends, e, k)), told).alias("own"))))

    def kept(blocks: Column) -> Column:
        tops = F.transform(blocks, lambda b, k: F.struct(F.array_max(b["own"]).alias("top"), b["block"].alias("block"), k.alias("k")))
        beside = lambda t, d: F.coalesce(F.exists(F.get(blocks, t["k"] + d)["own"], lambda y: (F.abs(y["before"] - t["top"]["before"]) < width) & (y > t["top"])), F.lit(False))
        return F.transform(F.filter(tops, lambda t: ~beside(t, -1) & ~beside(t, 1)), lambda t: t["top"])

    return let(F.sort_array(made), lambda m: let(cut(m), kept))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each unit that matches a template, with the best of them: id, unit (line, paragraph, text or window), place (its number from 1), license, dice.

    Units are the lines of a text, its paragraphs (between blank lines, when they have several lines), the whole text, and
    windows of as many words as a template has, from every word on (place: its number) that puts one of the template's anchors in
    its own place: these find a licence that stands among other lines, paragraphs or words. Windows of a template are
    told where no other unit of the text matches it; of overlapping ones the best, of equal ones the first. A unit with
    n distinct bigrams is compared only with templates of m where n and m allow `least` at all, that is n <= m * (2 - least) / least
    and the other way round. A text without any of the `anchor_words` can't hold a match and is left early. All of a
    row's work stays in the row. Null and empty texts, and units without two words, match nothing. Equal rows give equal
    rows; an empty table gives none; other columns, whatever their names, are left behind.
    """
    sizes = {k: len(bigrams(t)) for k, t in templates.items()}
    reach = (2 - least) / least
    low, high = min(sizes.values()) / reach, max(sizes.values()) * reach
    listed = lambda words: F.split(F.lit("|".join(words)), r"\|")  # noqa: E731  one literal, folded to an array once
    grams = {k: listed(sorted(f"{a} {b}" for a, b in bigrams(t))).alias("g") for k, t in templates.items()}
    value = F.coalesce(F.col(text), F.lit(""))
    lone = docs.select(F.col(id_column), value.alias("value"), _words(value).alias("w"))
    held = lone.filter(F.arrays_overlap("w", listed(anchor_words(templates, least))))

    lines, paragraphs = F.split("value", "\n"), F.split("value", r"\n[ \t\r]*\n")
    kind = lambda name, units: F.transform(units, lambda u, i: F.struct(F.lit(name).alias("unit"), (i + 1).alias("place"), u.alias("s")))
    several = F.filter(kind("paragraph", paragraphs), lambda u: F.instr(u["s"], "\n") > 0)
    whole = F.when(F.size(lines) > 1, kind("text", F.array("value"))).otherwise(kind("text", F.array(F.substring("value", 1, 0))))
    # characters bound words and so bigrams: a unit with m bigrams has at least 2m + 1 characters
    units = F.filter(F.concat(kind("line", lines), several, whole), lambda u: F.length(u["s"]) > 2 * low)
    dice = lambda b, g: 2 * F.size(F.array_intersect(b, g)) / (F.size(b) + F.size(g))

    # units: the best of the templates that match (of equal ones the last name)
    known = F.array(*[F.struct(F.lit(k).alias("license"), g) for k, g in sorted(grams.items())])

    def compared(b: Column) -> Column:
        fits = lambda t: (F.size(t["g"]) <= F.size(b) * reach + 1e-9) & (F.size(b) <= F.size(t["g"]) * reach + 1e-9)
        told = lambda t: F.struct(dice(b, t["g"]).alias("dice"), t["license"].alias("license"))
        some = (F.size(b) >= low) & (F.size(b) <= high)
        return F.array_max(F.when(some, F.filter(F.transform(F.filter(known, fits), told), lambda t: t["dice"] >= least)))

    found = held.select(id_column, F.explode(units).alias("u")).select(id_column, F.col("u.unit").alias("unit"), F.col("u.place").alias("place"), _words(F.col("u.s")).alias("w"))
    paired = found.filter(F.size("w") > low).withColumn("b", let(F.col("w"), _pairs))
    matched = paired.select(id_column, "unit", "place", let(F.col("b"), compared).alias("m")).filter("m IS NOT NULL")
    matched = matched.select(id_column, "unit", "place", F.col("m.license").alias("license"), F.col("m.dice").alias("dice"))

    # windows: a row for each text and template with a common anchor
    placed = F.array(*[F.struct(F.lit(k).alias("license"), grams[k], listed([g for g, _ in anchors(t, least)]).alias("anchors"), F.from_json(F.lit(str([i for _, i in anchors(t, least)])), "array<int>").alias("at"), F.lit(len(normal_words(t))).alias("words")) for k, t in sorted(templates.items())])
    all_pairs = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get("w", i + 1)))
    near = held.select(id_column, "value", "w", F.explode(let(all_pairs, lambda p: F.transform(F.filter(placed, lambda t: F.arrays_overlap(p, t["anchors"])), lambda t: F.struct(t.alias("t"), p.alias("pairs"))))).alias("x"))
    near = near.select(id_column, "value", "w", "x.t.*", "x.pairs")
    # a window that matches holds `needed` of the template's bigrams: a text without them has no window of it
    reached = near.filter(F.size(F.array_intersect("pairs", "g")) * reach >= F.size("g") - 1e-9)
    start = lambda b, i: let(F.array_position("anchors", b), lambda p: F.when(p > 0, F.greatest(i - F.get("at", (p - 1).cast("int")), F.lit(0))))
    starts = F.array_distinct(F.filter(F.transform("pairs", start), lambda i: i.isNotNull()))
    made = F.transform(starts, lambda i: F.struct(i.alias("start"), let(F.array_distinct(_range("pairs", i, F.col("words") - 1)), lambda b: dice(b, F.col("g"))).alias("dice")))
    alike = F.exists(units, lambda u: let(let(_words(u["s"]), _pairs), lambda b: (F.size(b) > 0) & (dice(b, F.col("g")) >= least)))
    some = F.filter(F.array(F.filter(made, lambda x: x["dice"] >= least)), lambda m: (F.size(m) > 0) & ~alike)
    told = reached.select(id_column, "license", "words", F.explode(some).alias("made"))
    windows = told.select(id_column, "license", F.explode(_best("made", F.col("words"))).alias("m")).select(id_column, F.lit("window").alias("unit"), (1 - F.col("m.before")).alias("place"), "license", "m.dice")
    return matched.unionByName(windows)


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "unit", F.col("place").cast("long").alias("place"), "license", F.round("dice", 6).alias("dice"))


def op2_sql() -> str:
    listed = lambda words: f"[{', '.join(map(repr, words))}]"
    rows = ", ".join(f"('{k}', {listed(sorted(f'{a} {b}' for a, b in bigrams(t)))}, {len(normal_words(t))})" for k, t in sorted(TEMPLATES.items()))
    anchored = ", ".join(f"('{k}', '{g}', {i})" for k, t in sorted(TEMPLATES.items()) for g, i in anchors(t))
    return f"""
WITH templates(license, g, words) AS (VALUES {rows}),
anchors(license, pair, offs) AS (VALUES {anchored}),
parts AS (
  SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS lines,
         string_split_regex(coalesce(text, ''), '\\n[ \\t\\r]*\\n') AS paragraphs FROM documents),
units AS (
  SELECT doc_id, 'line' AS unit, unnest(range(1, len(lines) + 1)) AS place, unnest(lines) AS s FROM parts
  UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph', unnest(range(1, len(paragraphs) + 1)) AS place, unnest(paragraphs) AS s FROM parts) WHERE contains(s, chr(10))
  UNION ALL SELECT doc_id, 'text', 1, t FROM parts WHERE len(lines) > 1),
worded AS (SELECT doc_id, unit, place, regexp_extract_all(lower(s), '[a-z0-9]+') AS w FROM units),
paired AS (SELECT doc_id, unit, place, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS b FROM worded WHERE len(w) > 1),
dices AS (SELECT doc_id, unit, place, license, 2.0 * len(list_intersect(b, g)) / (len(b) + len(g)) AS dice FROM paired, templates
          WHERE len(b) * {LEAST} <= len(g) * {2 - LEAST} AND len(g) * {LEAST} <= len(b) * {2 - LEAST}),
found AS (SELECT doc_id, unit, place, max_by(license, (dice, license)) AS license, max(dice) AS dice FROM dices WHERE dice >= {LEAST} GROUP BY doc_id, unit, place),
texts AS (SELECT doc_id, regexp_extract_all(lower(t), '[a-z0-9]+') AS w FROM parts),
pairs AS (SELECT doc_id, i - 1 AS i, w[i] || ' ' || w[i + 1] AS pair FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM texts)),
starts AS (SELECT DISTINCT doc_id, license, greatest(i - offs, 0) AS start FROM pairs JOIN anchors USING (pair)),
cut AS (SELECT doc_id, license, start, words, g, list_slice(w, start + 1, start + words) AS w FROM starts JOIN texts USING (doc_id) JOIN templates USING (license)
        WHERE NOT EXISTS (SELECT 1 FROM dices f WHERE f.dice >= {LEAST} AND f.doc_id = starts.doc_id AND f.license = starts.license)),
spans AS (SELECT doc_id, license, start, words, g, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS b FROM cut),
windows AS (SELECT * FROM (SELECT doc_id, license, start, words, 2.0 * len(list_intersect(b, g)) / (len(b) + len(g)) AS dice FROM spans) WHERE dice >= {LEAST})
SELECT doc_id, unit, place::BIGINT AS place, license, round(dice, 6) AS dice FROM found
UNION ALL SELECT doc_id, 'window', (start + 1)::BIGINT, license, round(dice, 6) FROM windows x
WHERE NOT EXISTS (SELECT 1 FROM windows y WHERE y.doc_id = x.doc_id AND y.license = x.license AND abs(x.start - y.start) < x.words AND (y.dice > x.dice OR (y.dice = x.dice AND y.start < x.start)))
"""
