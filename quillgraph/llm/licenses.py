"""License scans by Dice coefficient over word bigrams.

A text is normalised (lower case, runs of other signs than letters and digits
become one blank) and compared to licence templates line by line, paragraph by
paragraph, as a whole, by runs of consecutive sentences over lines and
paragraphs, and by windows of as many words as the template has. For sets A and
B of bigrams, Dice is 2|A and B| / (|A| + |B|), which is at most
2 min / (|A| + |B|): so a run ends where its words pass that bound. A template
at the limit shares at least limit / (2 - limit) of its bigrams with the text:
others are not compared.

Templates of which one is found in the other, but not wholly, are close. Where
spans of close templates overlap, only the one of the higher coefficient counts.

Defined cases: a null text has no units. Of a template's equal scores in one
document the first line counts. Each row is scanned by itself, so repeated rows
give repeated results and null ids pass through. An empty table gives an empty
table.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Mapping
from itertools import accumulate

import regex
from pyspark.sql import DataFrame

from quillgraph.llm.common import each_found

#: Licence notices as they are commonly written.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-2": "This project is licensed under the terms of the MIT license.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}
LIMIT = 0.8
_GAP = regex.compile(r"[^\p{L}\p{N}\n]+")
_SENTENCE = regex.compile(r"(?<=[.!?])\s+")


def normal(text: str) -> str:
    return _GAP.sub(" ", text.lower())


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


class Matcher:
    def __init__(self, templates: Mapping[str, str] = TEMPLATES, limit: float = LIMIT):
        self.limit = limit
        words = {k: normal(v).split() for k, v in templates.items()}
        self.sizes = {k: len(v) - 1 for k, v in words.items()}
        self.sets = {k: bigrams(v) for k, v in words.items()}
        self.any = frozenset().union(*self.sets.values())
        self.least = {k: limit / (2 - limit) * len(v) - 1e-9 for k, v in self.sets.items()}
        self.close: dict[str, set[str]] = {k: set() for k in templates}
        for one, text in templates.items():
            for other, spans in self.spans(text)[0].items():
                if other != one and spans[0][0] < 1:
                    self.close[one].add(other)
                    self.close[other].add(one)

    def spans(self, text: str) -> tuple[dict[str, list[tuple[float, int, int]]], list[int]]:
        """For each template found: Dice, first and last word of spans apart from each other, best first; and each word's line."""
        lines = [line.split() for line in normal(text).split("\n")]
        words = [w for line in lines for w in line]
        pairs = list(zip(words, words[1:]))
        shared = self.any.intersection(pairs)
        names = [k for k, v in self.sets.items() if shared and len(shared & v) >= self.least[k]]
        if not names:
            return {}, []
        at = [k for k, line in enumerate(lines) for _ in line]
        starts = [0, *accumulate(map(len, lines))]
        # Units that are compared whatever their length: lines, paragraphs, the whole text.
        units = [(starts[k], starts[k + 1] - 1) for k in range(len(lines))] + [(0, len(words) - 1)]
        start = 0
        for k in range(len(lines) + 1):
            if k == len(lines) or not lines[k]:
                units.append((starts[start], starts[k] - 1))
                start = k + 1
        units = sorted({u for u in units if u[1] > u[0]})
        ends = []  # one beyond the last word of each sentence
        for line in text.lower().split("\n"):
            for part in _SENTENCE.split(line):
                n = len(_GAP.sub(" ", part).split())
                if n:
                    ends.append(n)
        ends = list(accumulate(ends))
        return {k: found for k in names if (found := self._apart(self._found(k, pairs, units, ends)))}, at

    def _found(self, name: str, pairs: list, units: list[tuple[int, int]], ends: list[int]) -> list[tuple[float, int, int]]:
        template, size, least = self.sets[name], self.sizes[name], self.least[name]
        hits = [0, *accumulate(p in template for p in pairs)]
        out = []

        def note(own: set, first: int, last: int) -> None:
            dice = 2 * len(own & template) / (len(own) + len(template))
            if dice >= self.limit:
                out.append((dice, first, last))

        for first, last in units:
            if hits[last] - hits[first] >= least:
                note(set(pairs[first:last]), first, last)
        for first in range(max(0, len(pairs) - size + 1)):
            last = first + size
            if hits[last] - hits[first] >= least and (pairs[first] in template or pairs[last - 1] in template):
                note(set(pairs[first:last]), first, last)
        most = size * (2 - self.limit) / self.limit
        begins = [0, *ends[:-1]]
        for k, first in enumerate(begins):
            if hits[min(len(pairs), first + int(most))] - hits[first] < least or hits[min(len(pairs), ends[k])] == hits[first]:
                continue
            own: set = set()
            done = first
            for end in ends[k:]:
                if end - 1 - first > most:
                    break
                own.update(pairs[done : end - 1])
                grew, done = hits[end - 1] > hits[done], end - 1
                if grew and hits[done] - hits[first] >= least:
                    note(own, first, done)
        return out

    @staticmethod
    def _apart(found: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
        """Best first, without those that overlap a better one."""
        kept, taken = [], []  # taken: (first, last) in order
        for one in sorted(set(found), key=lambda x: (-x[0], x[1], x[2])):
            k = bisect(taken, one[1:])
            if (k == 0 or taken[k - 1][1] < one[1]) and (k == len(taken) or one[2] < taken[k][0]):
                taken.insert(k, one[1:])
                kept.append(one)
        return kept

    def scan(self, text: str | None) -> dict[str, tuple[float, int, int]]:
        """For each template found: best Dice, first and last line (from 0)."""
        found, at = self.spans(text or "")
        best = {}
        for name, spans in found.items():
            rivals = [x for other in self.close[name] for x in found.get(other, ())]
            for dice, first, last in spans:
                if not any(x[0] > dice and x[1] <= last and first <= x[2] for x in rivals):
                    best[name] = (dice, at[first], at[last])
                    break
        return best


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, limit: float = LIMIT) -> DataFrame:
    """op10: doc_id, template, dice, first_line, last_line for each licence found in a row of ``docs``."""
    templates = dict(templates)

    def make():
        matcher = Matcher(templates, limit)

        def find(texts):
            rows = [(k, name, *found) for k, text in enumerate(texts) for name, found in sorted(matcher.scan(text).items())]
            return tuple(zip(*rows)) or ((), (), (), (), ())

        return find

    return each_found(docs, ["doc_id"], make, {"template": "string", "dice": "double", "first_line": "int", "last_line": "int"})
