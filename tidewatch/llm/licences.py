"""Licence scans: normalised text compared to licence templates by the Dice coefficient over word bigrams.

Only DataFrame expressions. A line, paragraph or whole text is a unit. Its bigram set can reach the threshold only with a
template whose set has a size within the bounds that the threshold gives, and only if it holds one of a few words that
are in more of the template's bigrams than may be missing; both prune without loss before any bigram is built.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Licence notices in common use, by SPDX name.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                   "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
                   "either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
            "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
            "the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
                "file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Words that are in most English texts are markers only where nothing else is left.
_FREQUENT = frozenset("a all and any are as at be by can can for from in is it may not of on or that the this to under use was with without you".split())
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BLANK_LINE = r"\n[ \t\r]*\n"


def _words(text: str) -> list[str]:
    return re.sub(_BREAKS, " ", text.lower()).split()


def _bigrams(text: str) -> list[str]:
    words = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def marker_words(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[str]:
    """Words of which every unit that reaches the threshold with some template holds one.

    A unit shares at least ``threshold / (2 - threshold)`` of a template's bigrams; so many of them contain a marker that
    the others are fewer than that.
    """
    chosen: list[str] = []
    sets = [[b.split() for b in _bigrams(text)] for _, text in templates]
    while True:
        open_ = []
        for bigrams in sets:
            rest = [b for b in bigrams if not set(b) & set(chosen)]
            if len(rest) >= threshold / (2 - threshold) * len(bigrams):
                open_ += rest
        if not open_:
            return chosen
        counts = Counter(w for b in open_ for w in set(b))
        chosen.append(min(counts, key=lambda w: (w in _FREQUENT or w.isdigit(), -counts[w] * len(w), w)))


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _BREAKS, " "))


def _holds(text: Column, words: list[str]) -> Column:
    """One search for all words; short ones have to stand alone."""
    any_ = "|".join(w if len(w) > 3 else f"(?<![a-z0-9]){w}(?![a-z0-9])" for w in words if not any(o != w and len(o) > 3 and o in w for o in words))
    return text.rlike(any_)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``id, unit, position, licence, dice, n_bigrams`` of every unit that reaches the threshold, with its best template.

    Units are all lines, the paragraphs (between blank lines) of several lines, and the whole text if it has several
    paragraphs; positions count from 0. Of equally good templates the first name wins. Null and empty texts have no units,
    null ids are kept, repeated rows give rows each, no rows give none, other columns are ignored.
    """
    markers = marker_words(templates, threshold)
    kinds = sorted({(name, tuple(_bigrams(text))) for name, text in templates})
    known = F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, b)).alias("bigrams"), F.lit(len(b)).alias("n")) for name, b in kinds))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least, most = min(len(b) for _, b in kinds) * low, max(len(b) for _, b in kinds) * high

    # the filter is the only work on most texts; lower() finds whatever the slower translate() would
    texts = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(_holds(F.lower("text"), markers))
             .select("id", F.translate("text", _UPPER, _LOWER).alias("body")))
    paragraphs = F.split("body", _BLANK_LINE)

    def unit(kind: str):
        return lambda x, i: F.struct(F.lit(kind).alias("unit"), i.cast("long").alias("position"), x.alias("piece"))

    whole = F.when(F.size(paragraphs) > 1, F.transform(F.array("body"), unit("text")))
    several = F.filter(F.transform(paragraphs, unit("paragraph")), lambda u: u["piece"].contains("\n"))
    every = F.concat(F.transform(F.split("body", "\n"), unit("line")), several, F.coalesce(whole, F.slice(several, 1, 0)))
    units = (texts.select("id", F.explode(every).alias("u")).select("id", "u.*").filter(_holds(F.col("piece"), markers))
             .withColumn("words", F.split(_normal(F.col("piece")), " ")).filter((F.size("words") > least)))
    pairs = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    sized = units.select("id", "unit", "position", F.array_distinct(pairs).alias("bigrams")).withColumn("n", F.size("bigrams")).filter((F.col("n") >= least) & (F.col("n") <= most))
    near = F.filter(known, lambda t: (F.col("n") >= t["n"] * low - 1e-9) & (F.col("n") <= t["n"] * high + 1e-9))
    rated = F.transform(near, lambda t: F.struct((-2.0 * F.size(F.array_intersect(F.col("bigrams"), t["bigrams"])) / (F.col("n") + t["n"])).alias("against"), t["name"].alias("name")))
    best = sized.withColumn("best", F.array_min(rated)).filter(F.col("best.against") <= -threshold)
    return best.select(F.col("id").alias(id_col), "unit", "position", F.col("best.name").alias("licence"), F.round(-F.col("best.against"), 6).alias("dice"),
                       F.col("n").cast("long").alias("n_bigrams"))


def scan_sql(threshold: float = THRESHOLD) -> str:
    """The same for DuckDB, without the pruning by words."""
    kinds = sorted({(name, tuple(_bigrams(text))) for name, text in TEMPLATES})
    values = ", ".join("('{}', [{}])".format(name, ", ".join(f"'{b}'" for b in bigrams)) for name, bigrams in kinds)
    return rf"""
WITH templates(name, bigrams) AS (VALUES {values}),
texts AS (SELECT doc_id, translate(text, '{_UPPER}', '{_LOWER}') AS body FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, body, string_split(body, chr(10)) AS lines, regexp_split_to_array(body, '\n[ \t\r]*\n') AS paragraphs FROM texts),
units AS (
  SELECT doc_id, 'line' AS unit, i - 1 AS position, lines[i] AS piece FROM cut, unnest(range(1, len(lines) + 1)) AS r(i)
  UNION ALL SELECT doc_id, 'paragraph', i - 1, paragraphs[i] FROM cut, unnest(range(1, len(paragraphs) + 1)) AS r(i) WHERE contains(paragraphs[i], chr(10))
  UNION ALL SELECT doc_id, 'text', 0, body FROM cut WHERE len(paragraphs) > 1),
normal AS (SELECT doc_id, unit, position, string_split(trim(regexp_replace(piece, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')), ' ') AS words FROM units),
sets AS (SELECT doc_id, unit, position, list_distinct([words[i] || ' ' || words[i + 1] for i in range(1, len(words))]) AS bigrams FROM normal WHERE len(words) > 1),
rated AS (
  SELECT doc_id, unit, position, len(s.bigrams) AS n_bigrams, name,
         2.0 * len(list_intersect(s.bigrams, t.bigrams)) / (len(s.bigrams) + len(t.bigrams)) AS dice
  FROM sets s JOIN templates t ON len(s.bigrams) BETWEEN len(t.bigrams) * {threshold / (2 - threshold)} - 1e-9 AND len(t.bigrams) * {(2 - threshold) / threshold} + 1e-9)
SELECT doc_id, unit, CAST(position AS BIGINT) AS position, name AS licence, round(dice, 6) AS dice, CAST(n_bigrams AS BIGINT) AS n_bigrams
FROM rated WHERE dice >= {threshold}
QUALIFY row_number() OVER (PARTITION BY doc_id, unit, position ORDER BY dice DESC, name) = 1
"""
