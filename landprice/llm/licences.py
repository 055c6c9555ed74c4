"""Licence scan: passages whose word bigrams match a licence template.

Texts and templates are reduced to lower-case words. A passage matches a template if the Dice
coefficient of their bigram multisets, 2 * common / (passage + template), reaches the limit.
That bounds the passage's size on both sides and the number of bigrams it must share, so most
templates are dropped by counts alone; only passages from one shared bigram to another are
tried, since a passage gains nothing from bigrams at its ends that the template lacks.

Defined results: null or empty text matches nothing; of passages that overlap, the one with the
highest coefficient counts, of equal ones of one licence the earlier and then the shorter; equal
ones of different licences are all given; a repeated row gives repeated rows; an empty table
gives no rows; other columns are not read. A template of less than two words never matches.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame

from landprice.llm.batches import map_batches, sliced, texts

#: Dice coefficient from which a passage counts as the licence.
LIMIT = 0.8

#: Wording of public licences and of the notices that name them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
     "software and associated documentation files (the \"Software\"), to deal in the Software "
     "without restriction, including without limitation the rights to use, copy, modify, merge, "
     "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
     "to whom the Software is furnished to do so, subject to the following conditions: The above "
     "copyright notice and this permission notice shall be included in all copies or substantial "
     "portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use "
     "this file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
     "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
     "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the "
     "terms of the GNU General Public License as published by the Free Software Foundation, either "
     "version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the "
     "terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
     "either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without "
     "modification, are permitted provided that the following conditions are met: Redistributions "
     "of source code must retain the above copyright notice, this list of conditions and the "
     "following disclaimer. Redistributions in binary form must reproduce the above copyright "
     "notice, this list of conditions and the following disclaimer in the documentation and/or "
     "other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may "
     "be used to endorse or promote products derived from this software without specific prior "
     "written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
     "without fee is hereby granted, provided that the above copyright notice and this permission "
     "notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
     "If a copy of the MPL was not distributed with this file, You can obtain one at "
     "https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
     "International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    # Near relatives of the above, so that their wording is not taken for another licence.
    *(
        (name, f"This {what} is free software{mark} you can redistribute it and/or modify it under the "
         f"terms of the GNU {kind} as published by the Free Software Foundation{after} either version "
         f"{version} of the License, or (at your option) any later version.")
        for name, what, mark, kind, after, version in (
            ("GPL-2.0", "program", ";", "General Public License", ";", "2"),
            ("AGPL-3.0", "program", ":", "Affero General Public License", ",", "3"),
            ("LGPL-2.1", "library", ";", "Lesser General Public License", ";", "2.1"),
            ("LGPL-2.0", "library", ";", "Library General Public License", ";", "2"),
        )
    ),
    *(
        (name, f"This work is licensed under the GNU {kind}, version {version}.")
        for name, kind, version in (
            ("GPL-2.0", "General Public License", "2"),
            ("AGPL-3.0", "Affero General Public License", "3"),
            ("LGPL-3.0", "Lesser General Public License", "3"),
            ("LGPL-2.1", "Lesser General Public License", "2.1"),
            ("LGPL-2.0", "Library General Public License", "2"),
        )
    ),
    *(
        (f"CC-{kind}-{version}", text)
        for kind, name in (
            ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"),
            ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
            ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
            ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        )
        for version, place in (("4.0", "International"), ("3.0", "Unported"))
        for text in (
            f"Licensed under CC {kind} {version}.",
            f"This work is licensed under a Creative Commons {name} {version} {place} License.",
        )
        if (kind, version) not in (("BY", "4.0"), ("BY-NC", "4.0"))
        and (kind, version, text[:8]) != ("BY-SA", "4.0", "Licensed")
    ),
)

_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Match:
    licence: str
    template: int
    start: int
    end: int
    dice: float


class Scanner:
    """Templates by the bigrams they hold."""

    def __init__(self, templates: Iterable[tuple[str, str]] = TEMPLATES, limit: float = LIMIT):
        self.limit = limit
        self.names, self.bigrams = [], []
        self.holders: dict[tuple[str, str], list[int]] = defaultdict(list)
        for number, (name, text) in enumerate(templates):
            words = _WORD.findall(text.lower())
            own = Counter(zip(words, words[1:]))
            self.names.append(name)
            self.bigrams.append(own)
            for bigram in own:
                self.holders[bigram].append(number)

    @cached_property
    def _bounds(self) -> list[tuple[int, float, float]]:
        """Template size, least common bigrams and largest passage size of each template."""
        t, out = self.limit, []
        for own in self.bigrams:
            size = own.total()
            # 2c >= t (n + m) and c <= n, c <= m.
            out.append((size, t * size / (2 - t), (2 - t) * size / t))
        return out

    def matches(self, text: str) -> list[Match]:
        spans = [m.span() for m in _WORD.finditer(text)]
        words = [x.lower() for x in _WORD.findall(text)]
        holders = self.holders
        hits = [(i, pair) for i, pair in enumerate(zip(words, words[1:])) if pair in holders]
        if not hits:
            return []
        by_template: dict[int, list[tuple[int, tuple[str, str]]]] = defaultdict(list)
        for hit in hits:
            for number in holders[hit[1]]:
                by_template[number].append(hit)
        found: list[tuple[float, int, int, int]] = []
        for number, own in by_template.items():
            if len(own) >= self._bounds[number][1]:
                found += self._passages(number, own)
        out: list[Match] = []
        kept: list[tuple[float, int, int, str]] = []
        for dice, a, b, number in sorted(found):
            name = self.names[number]
            # A bigram reaches one word on: passages that share a word overlap.
            if all(
                b + 1 < first or last + 1 < a or dice == other and name != licence
                for other, first, last, licence in kept
            ):
                kept.append((dice, a, b, name))
                out.append(Match(name, number, spans[a][0], spans[b + 1][1], -dice))
        return sorted(out, key=lambda x: (x.start, x.end, x.licence))

    def _passages(self, number: int, hits: list) -> list[tuple[float, int, int, int]]:
        """Negated coefficient, first and last bigram and template of passages over the limit."""
        size, least, most = self._bounds[number]
        own, found = self.bigrams[number], []
        for k, (first, _) in enumerate(hits):
            open_, common = Counter(), 0
            for last, pair in hits[k:]:
                length = last - first + 1
                if length > most:
                    break
                if open_[pair] < own[pair]:
                    open_[pair] += 1
                    common += 1
                    dice = 2 * common / (length + size)
                    if common >= least and dice >= self.limit:
                        found.append((-dice, first, last, number))
        return found


def scan(
    df: DataFrame, id_column: str = "doc_id", text: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES, limit: float = LIMIT,
) -> DataFrame:
    """``doc_id``, ``licence``, ``template``, ``start``, ``end`` (characters), ``dice``."""

    def run(batches):
        scanner = Scanner(templates, limit)
        for batch in sliced(batches, "text"):
            rows = [
                (key, x.licence, x.template, x.start, x.end, x.dice)
                for key, value in zip(batch.column("id").to_pylist(), texts(batch, "text"))
                for x in scanner.matches(value)
            ]
            fields = zip(*rows) if rows else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
            names = ("doc_id", "licence", "template", "start", "end", "dice")
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), t) for x, t in zip(fields, kinds)], list(names)
            )

    rows = df.select(df[id_column].cast("long").alias("id"), df[text].cast("string").alias("text"))
    return map_batches(
        rows, run,
        "doc_id long, licence string, template int, start long, end long, dice double",
    )
