"""License scans: units of a text against licence templates by Dice coefficient over word bigrams.

A unit is a line, a paragraph (lines between blank lines) or the whole text.  Units and templates are
lower-cased and reduced to letters and digits.  The Dice coefficient of a unit with a bigrams and a template
with m can reach t only if a lies in [m t / (2 - t), m (2 - t) / t], so most units meet no template at all.
`matches` gives every template that a unit reaches, also where two differ in a word.

`notices` looks at windows of words at every place instead, so a notice inside a longer line, across lines or
between other sentences is found, and of templates that meet the same words only the best stays.  A best window
starts and ends with bigrams of its template, so only those places are tried.
Everything happens inside a row with built-in expressions: no shuffle, and a text is read whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

THRESHOLD = 0.8
# fixed values: notices and texts of public licences
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Proprietary": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, "
    "either version {1} of the License, or (at your option) any later version."
)
# what notices are looked for besides: (licence, text)
HEADERS = (
    ("AGPL-3.0", _GNU.format("Affero ", "3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", TEMPLATES["BSD-2-Clause"] + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("GPL-2.0", _GNU.format("", "2")),
    ("GPL-3.0", _GNU.format("", "3")),
    ("LGPL-2.1", _GNU.format("Lesser ", "2.1")),
    ("LGPL-3.0", _GNU.format("Lesser ", "3")),
)
NOTICES = (*TEMPLATES.items(), *HEADERS)


def template_bigrams(text: str) -> list[str]:
    words = [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(m: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """The sizes a unit may have to reach the threshold with a template of m bigrams."""
    return -int(-m * threshold // (2 - threshold)), int(m * (2 - threshold) / threshold)


def units(text: Column) -> Column:
    """Normalised lines, paragraphs and the whole text, each once."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")
    flat = lambda parts: F.transform(parts, lambda u: F.trim(F.regexp_replace(u, r"[ \n]+", " ")))
    return F.array_distinct(F.concat(flat(F.split(plain, "\n")), flat(F.split(plain, r"\n *\n")), flat(F.array(plain))))


def _with(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def matches(text: Column, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """array<struct<licence, dice>> of the units that reach the threshold with a template; empty for null or empty text.

    A unit's bigrams count with repeats, a template's once.
    """
    sized = {name: template_bigrams(t) for name, t in templates.items()}
    lowest, highest = min(bounds(len(b), threshold)[0] for b in sized.values()), max(bounds(len(b), threshold)[1] for b in sized.values())

    none = F.array().cast("array<struct<licence:string,dice:double>>")

    def against(pairs: Column, size: Column) -> Column:
        every = []
        for name, grams in sized.items():
            low, high = bounds(len(grams), threshold)
            common = F.size(F.array_intersect(pairs, F.array(*map(F.lit, grams))))
            dice = F.when(size.between(low, high), F.lit(2.0) * common / (size + len(grams)))
            every.append(F.struct(F.lit(name).alias("licence"), dice.alias("dice")))
        return F.filter(F.array(*every), lambda m: m["dice"] >= threshold)

    def of_words(words: Column) -> Column:
        size = F.size(words) - 1
        pairs = F.zip_with(F.slice(words, 1, size), F.slice(words, 2, size), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.when(size.between(lowest, highest), _with(F.array_distinct(pairs), lambda p: against(p, size))).otherwise(none)

    of_unit = lambda unit: _with(F.split(unit, " "), of_words)
    return F.flatten(F.transform(units(F.coalesce(text, F.lit(""))), of_unit))


def notices(text: Column, templates: tuple[tuple[str, str], ...] = NOTICES, threshold: float = THRESHOLD) -> Column:
    """array<struct<licence, dice, start, stop>> of the notices in a text, without overlaps; empty for null or empty text.

    A window is a run of bigrams `start` to `stop` (numbers of their first words).  With c different bigrams in common,
    `size` of its own and m of the template, its Dice coefficient is 2 c / (size + m) and its score 4 c - size - m.  Windows
    are taken by score, Dice coefficient, place and licence; one that overlaps a taken one is left out unless it is
    the same window of another licence with the same score: then the words do not tell them apart and both stay.
    """
    sized = [(name, template_bigrams(t)) for name, t in templates]
    every = sorted({g for _, grams in sized for g in grams})
    kind = "array<struct<below:int,off:double,start:int,licence:string,stop:int>>"
    none = F.array().cast(kind)

    def windows(hits: Column, name: str, m: int) -> Column:
        """The best window from every place, of bigrams (i, before) with the place of the same bigram before."""
        high = bounds(m, threshold)[1]

        def from_place(h: Column, k: Column) -> Column:
            new = F.filter(F.slice(hits, k + 1, high), lambda x: (x["i"] < h["i"] + high) & (x["before"] < h["i"]))

            def to_place(x: Column, j: Column) -> Column:
                both = x["i"] - h["i"] + 1 + m
                return F.struct(
                    (both - 4 * (j + 1)).alias("below"), (F.lit(-2.0) * (j + 1) / both).alias("off"), h["i"].alias("start"), F.lit(name).alias("licence"), x["i"].alias("stop")
                )

            return F.array_min(F.filter(F.transform(new, to_place), lambda w: w["off"] <= -threshold))

        return F.filter(F.transform(hits, from_place), lambda w: w.isNotNull())

    def linked(hits: Column) -> Column:
        def all_of(ordered: Column) -> Column:
            def before(h: Column, k: Column) -> Column:
                last = F.get(ordered, k - 1)
                return F.struct(h["i"].alias("i"), F.when(last["p"] == h["p"], last["i"]).otherwise(-1).alias("before"))

            return F.array_sort(F.transform(ordered, before))

        return _with(F.array_sort(F.transform(hits, lambda h: F.struct(h["p"].alias("p"), h["i"].alias("i")))), all_of)

    def of_template(hits: Column, name: str, grams: list[str]) -> Column:
        least = bounds(len(grams), threshold)[0]
        meet = lambda own: _with(linked(own), lambda h: windows(h, name, len(grams))).cast(kind)
        return _with(F.filter(hits, lambda h: h["p"].isin(grams)), lambda own: F.when(F.size(own) >= least, meet(own)).otherwise(none))

    def against(hits: Column) -> Column:
        return F.array_sort(F.flatten(F.array(*[of_template(hits, name, grams) for name, grams in sized])))

    def add(taken: Column, w: Column) -> Column:
        same = lambda o: (o["start"] == w["start"]) & (o["stop"] == w["stop"]) & (o["below"] == w["below"]) & (o["off"] == w["off"]) & (o["licence"] != w["licence"])
        met = F.exists(taken, lambda o: (o["start"] <= w["stop"]) & (w["start"] <= o["stop"]) & ~same(o))
        return F.when(met, taken).otherwise(F.concat(taken, F.array(w)))

    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))

    def of_words(words: Column) -> Column:
        size = F.size(words) - 1
        pairs = F.zip_with(F.slice(words, 1, size), F.slice(words, 2, size), lambda a, b: F.concat(a, F.lit(" "), b))
        placed = F.transform(pairs, lambda p, i: F.when(p.isin(every), F.struct(i.alias("i"), p.alias("p"))))
        return _with(F.filter(placed, lambda h: h.isNotNull()), against)

    taken = F.aggregate(_with(F.split(plain, " "), of_words), none, add)
    return F.transform(taken, lambda w: F.struct(w["licence"].alias("licence"), (-w["off"]).alias("dice"), w["start"].alias("start"), w["stop"].alias("stop")))
