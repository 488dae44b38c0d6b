"""Licence scan: text against licence templates by Dice's coefficient over word bigrams.

Each line of a document, each of its paragraphs of several lines (parted by empty lines)
and the whole of a document of several paragraphs is a unit. Units and templates are
lower-cased, runs of other characters than a-z and 0-9 count as one space, and the sets of
their word bigrams are compared: 2 * common / (a + b). A template with b bigrams can only
reach a threshold t with a unit of t * b / (2 - t) to (2 - t) * b / t bigrams, which prunes
templates before any intersection; a unit that shares no bigram with any template is done
at once. All of it is expressions over a row: nothing is shuffled, and the templates are
a table of fixed size.

Null text has no unit; a unit of one word has no bigram and matches nothing. Of templates
with equal coefficients the first by name is reported. Repeated rows are reported each,
empty tables give an empty result, and other columns are not looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyline.llm._base import load

THRESHOLD = 0.8

#: Statements and notices in common use by which a text is put under a licence.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Fewest and most bigrams of a unit that can reach the threshold with ``size`` others."""
    common = [(n, 2 * min(n, size) / (n + size)) for n in range(1, int(2 * size / threshold) + 2)]
    fits = [n for n, best in common if best >= threshold]
    return fits[0], fits[-1]


def units(text: Column) -> Column:
    """Structs (kind, place, text) of all units of a text."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(F.lit("line").alias("kind"), i.cast("long").alias("place"), x.alias("unit")))
    parts = F.transform(F.split(text, r"\n[ \t\r]*\n"), lambda x, i: F.struct(F.lit("paragraph").alias("kind"), i.cast("long").alias("place"), x.alias("unit")))
    parts = F.filter(parts, lambda p: F.contains(p["unit"], F.lit("\n")))
    whole = F.array(F.struct(F.lit("document").alias("kind"), F.lit(0).cast("long").alias("place"), text.alias("unit")))
    whole = F.filter(whole, lambda p: F.regexp_like(text, F.lit(r"\n[ \t\r]*\n")))
    return F.concat(lines, parts, whole)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, kind, place, license, dice of every unit that reaches the threshold with a template."""
    known = [(name, grams, *bounds(len(grams), threshold)) for name, grams in ((n, bigrams_of(t)) for n, t in templates) if grams]
    every = sorted({g for _, grams, _, _ in known for g in grams})
    least, most = min(k[2] for k in known), max(k[3] for k in known)
    words = F.filter(units(F.col("text")), lambda u: F.length(u["unit"]) >= 2 * least + 1)
    words = F.transform(words, lambda u: F.struct(u["kind"].alias("kind"), u["place"].alias("place"), F.filter(F.split(F.lower(u["unit"]), "[^a-z0-9]+"), lambda w: w != "").alias("w")))
    words = F.filter(words, lambda u: F.size(u["w"]) > least)
    grams_of = lambda w: F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda x, y: F.concat(x, F.lit(" "), y)))
    sets = F.transform(words, lambda u: F.struct(u["kind"].alias("kind"), u["place"].alias("place"), grams_of(u["w"]).alias("grams")))
    sets = F.filter(sets, lambda u: (F.size(u["grams"]) <= most) & F.exists(u["grams"], lambda g: g.isin(every)))
    unit = docs.select("doc_id", F.explode(sets).alias("u")).select("doc_id", "u.kind", "u.place", "u.grams")
    cases = []
    for name, grams, low, high in known:
        common = F.size(F.array_intersect("grams", F.array(*[F.lit(g) for g in grams])))
        dice = F.when(F.size("grams").between(low, high), F.lit(2.0) * common / (F.size("grams") + F.lit(len(grams))))
        cases.append(F.struct(dice.alias("dice"), F.lit(name).alias("license")))
    fits = F.filter(F.array(*cases), lambda c: c["dice"] >= F.lit(threshold))
    unit = unit.select("doc_id", "kind", "place", fits.alias("fits")).filter(F.size("fits") > 0)
    dice = F.array_max(F.transform("fits", lambda c: c["dice"]))
    unit = unit.withColumn("dice", dice)
    license_name = F.array_min(F.transform(F.filter("fits", lambda c: c["dice"] == F.col("dice")), lambda c: c["license"]))
    return unit.select("doc_id", "kind", "place", license_name.alias("license"), "dice")


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents"))


def _sql(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    rows = ", ".join("('{}', [{}])".format(name, ", ".join(f"'{g}'" for g in bigrams_of(text))) for name, text in templates)
    return rf"""
WITH t(license, grams) AS (VALUES {rows}),
u AS (
  SELECT doc_id, 'line' AS kind, unnest(string_split(text, chr(10))) AS unit, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents
  UNION ALL
  SELECT doc_id, 'paragraph', unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')), unnest(range(len(regexp_split_to_array(text, '\n[ \t\r]*\n')))) FROM documents
  UNION ALL
  SELECT doc_id, 'document', text, 0 FROM documents WHERE regexp_matches(text, '\n[ \t\r]*\n')),
w AS (
  SELECT doc_id, kind, place, regexp_extract_all(lower(unit), '[a-z0-9]+') AS w FROM u
  WHERE kind <> 'paragraph' OR contains(unit, chr(10))),
g AS (
  SELECT doc_id, kind, place, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams
  FROM w WHERE len(w) > 1),
d AS (
  SELECT doc_id, kind, place, license,
         2.0::DOUBLE * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice
  FROM g, t WHERE len(g.grams) <= 400),
b AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, kind, place ORDER BY dice DESC, license) AS nth FROM d WHERE dice >= {threshold})
SELECT doc_id, kind, CAST(place AS BIGINT) AS place, license, dice FROM b WHERE nth = 1
"""


SQL = _sql()
