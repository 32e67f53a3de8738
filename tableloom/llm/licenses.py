"""Licence notices found by Dice coefficients over word bigrams."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import LOWER, pick, raw, slices

#: Notices and short licences as their publishers word them, by SPDX-like name.
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("bsd-2-clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("bsd-3-clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("cc0-1.0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("cc-by-nc-nd-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-sa-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
#: Words that part variants of one licence; so do numbers.  A window that has others than its template is another licence.
VARIANTS = frozenset("affero lesser library nc nd sa by noncommercial noderivatives noderivs sharealike neither apache mit bsd isc mozilla eclipse".split())

WORD = re.compile(rb"[a-z0-9]+")
MARKS = frozenset(x.encode() for x in VARIANTS)


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.translate(LOWER))


def marks_of(words: list[bytes]) -> frozenset[bytes]:
    """The words that tell a variant: numbers and VARIANTS."""
    return frozenset(w for w in words if w in MARKS or w.isdigit())


class Template:
    """A template's bigrams, marks and the bounds of what can match it.

    Sets of sizes a and b have a Dice coefficient of at most 2 min / (a + b),
    so one of at least t needs min >= max t / (2 - t).
    """

    def __init__(self, name: str, text: str, least: float):
        words = words_of(text.encode())
        self.name, self.bigrams, self.marks = name, frozenset(zip(words, words[1:])), marks_of(words)
        ratio, exact = (2 - least) / least, 1e-9  # bounds that a window meets exactly count as met
        self.low, self.high = len(self.bigrams) / ratio - exact, len(self.bigrams) * ratio + exact
        self.longest = int((len(words) - 1) * ratio + exact)  # bigrams of a window, repeated ones too

    def windows(self, words: list[bytes], places: list[int], least: float) -> Iterator[tuple[float, int, int]]:
        """(coefficient, first, last bigram) of the windows of a text that match; places are those of the template's bigrams."""
        need = -int(-self.low // 1)
        for k, a in enumerate(places):
            # too few of the template's bigrams follow within the longest window
            if k + need > len(places) or places[k + need - 1] - a >= self.longest:
                continue
            seen: set[tuple[bytes, bytes]] = set()
            met, at = 0, a
            for b in places[k:]:
                if b - a >= self.longest:
                    break
                for i in range(at, b + 1):
                    pair = words[i], words[i + 1]
                    if pair not in seen:
                        seen.add(pair)
                        met += pair in self.bigrams
                at = b + 1
                if not self.low <= len(seen) <= self.high:
                    continue
                dice = 2 * met / (len(seen) + len(self.bigrams))
                if dice >= least and marks_of(words[a : b + 2]) == self.marks:
                    yield dice, a, b


class Templates:
    def __init__(self, templates: tuple[tuple[str, str], ...], least: float):
        self.least = least
        self.all = [t for t in (Template(n, x, least) for n, x in templates) if t.bigrams]
        self.by_bigram = defaultdict(list)
        for k, t in enumerate(self.all):
            for pair in t.bigrams:
                self.by_bigram[pair].append(k)

    def notices(self, text: bytes) -> list[tuple[float, str]]:
        """(coefficient, name) of each notice of a text: of windows that overlap, the best (ties: the first name)."""
        words = words_of(text)
        found = self.by_bigram.keys() & set(zip(words, words[1:]))
        hits = Counter(k for pair in found for k in self.by_bigram[pair])
        wanted = {k for k, n in hits.items() if n >= self.all[k].low}
        if not wanted:
            return []
        places = defaultdict(list)
        for i, pair in enumerate(zip(words, words[1:])):
            if pair in found:
                for k in self.by_bigram[pair]:
                    if k in wanted:
                        places[k].append(i)
        met = sorted((a, b, -dice, self.all[k].name) for k in wanted for dice, a, b in self.all[k].windows(words, places[k], self.least))
        out, end = [], -1
        for a, b, less, name in met:
            if a > end:
                out.append((less, name))
            else:
                out[-1] = min(out[-1], (less, name))
            end = max(end, b)
        return [(-less, name) for less, name in out]


def scan(docs: DataFrame, *, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """Licence notices in each document.

    Text is lowered (A-Z) and cut into words of letters a-z and digits, so line
    ends, white space and punctuation do not matter.  Windows of words that
    begin and end with a bigram of a template are compared with it by the Dice
    coefficient of their sets of bigrams.  Templates that share too few bigrams
    with a text are never compared; nor are windows whose size rules a
    coefficient of `least` out, or that are longer than (2 - least) / least
    times the template.  Numbers and the words that part variants of a licence
    must be the template's.  Input: `doc_id` and `text`; further columns are
    ignored.  Output, a row for each input row: doc_id, n_notices (matching
    windows, those that overlap counted as one), license (of the best notice;
    ties: the first name; null if none), dice (of that notice, 0 if none),
    licenses (names of all notices, ascending, comma-joined).  Null and empty
    texts match nothing; equal texts give equal rows.  Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, least)
        for batch in slices(batches, "text", 8_000_000):
            rows = []
            for text in raw(batch.column("text")):
                found = known.notices(text) if text else []
                dice, name = min(((-d, n) for d, n in found), default=(0.0, None))
                rows.append((len(found), name, -dice or 0.0, ",".join(sorted({n for _, n in found}))))
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.string())
            columns = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_notices", "license", "dice", "licenses"])

    d = pick(docs, "doc_id", text="string")
    return d.mapInArrow(run, f"doc_id {d.dtypes[0][1]}, n_notices bigint, license string, dice double, licenses string")


_ROWS = ", ".join("({}, '{}', '{}')".format(k, n, t.replace("'", "''")) for k, (n, t) in enumerate(TEMPLATES))
_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
_MARKS = "list_sort(list_distinct(list_filter({}, lambda w: regexp_matches(w, '^([0-9]+|{})$'))))".format("{}", "|".join(sorted(VARIANTS)))
#: The result over `documents` as DuckDB SQL.
ORACLE = f"""
WITH t AS (SELECT *, {_MARKS.format("ws")} AS marks, list_distinct([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) AS tb FROM (SELECT k, name, {_WORDS.format("x")} AS ws FROM (VALUES {_ROWS}) AS v(k, name, x))),
tb AS (SELECT k, unnest(tb) AS pair FROM t),
d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
p AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] AS pair FROM (SELECT r, ws, unnest(range(1, len(ws))) AS i FROM d)),
m AS (SELECT r, i, k, pair FROM p JOIN tb USING (pair)),
near AS (SELECT r, k FROM m JOIN t USING (k) GROUP BY r, k HAVING 3 * count(DISTINCT pair) >= 2 * len(any_value(tb))),
g AS (SELECT r, k, i FROM m JOIN near USING (r, k)),
w AS (SELECT x.r, x.k, x.i AS a, y.i AS b FROM g x JOIN g y ON x.r = y.r AND x.k = y.k AND y.i >= x.i JOIN t ON t.k = x.k WHERE y.i - x.i < 3 * (len(ws) - 1) // 2 AND 3 * (y.i - x.i + 1) >= 2 * len(tb)),
s AS (SELECT w.*, name, tb, marks, list_slice(d.ws, a, b + 1) AS own FROM w JOIN d USING (r) JOIN t USING (k)),
c AS (SELECT *, list_distinct([own[i] || ' ' || own[i + 1] for i in range(1, len(own))]) AS sb FROM s WHERE {_MARKS.format("own")} = marks),
e AS (SELECT r, a, b, name, 2 * len(list_intersect(tb, sb))::DOUBLE / (len(tb) + len(sb)) AS dice FROM c WHERE 3 * len(sb) >= 2 * len(tb) AND 2 * len(sb) <= 3 * len(tb)),
f AS (SELECT *, coalesce(max(b) OVER (PARTITION BY r ORDER BY a, b, dice DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM e WHERE dice >= 0.8),
h AS (SELECT *, sum(CASE WHEN a > before THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY a, b, dice DESC, name ROWS UNBOUNDED PRECEDING) AS notice FROM f),
best AS (SELECT r, notice, name, dice FROM h QUALIFY row_number() OVER (PARTITION BY r, notice ORDER BY dice DESC, name) = 1),
o AS (SELECT r, count(*) AS n, first(name ORDER BY dice DESC, name) AS license, max(dice) AS dice, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM best GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_notices, license, coalesce(dice, 0) AS dice, coalesce(licenses, '') AS licenses FROM d LEFT JOIN o USING (r)
"""
