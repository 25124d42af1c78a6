"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Each template's words are cut into three-word grams; of every three consecutive grams the one
with the least hash goes into an inverted index of (template, place), so a text that holds five
consecutive words of a template hits the index. A text's words are looked up in the templates'
vocabulary, and each run of three in the index; hits of a template on nearby diagonals form one
candidate, in which local alignments within a band around those diagonals are sought. A match reports
how much of the template it covers and which words of the text it spans.

The index is built from the templates given (``MAX_TEMPLATE_WORDS`` in all) and goes with each
task; texts are never shuffled.

Defined results: null and wordless texts have no matches; a text gives a row for each match,
repeated rows each their own; of matches of one template that overlap the one that covers more
stays, then the earlier; templates may match the same words; a template of fewer than three
words is an error; no templates, or an empty table, give no matches; other columns are left out.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from symgrain.llm.common import trimmed

GRAM, WINDOW = 3, 3
BAND, LEAST_COVERAGE = 8, 0.7
#: Candidates of a long template whose diagonals lie a quarter of its length apart at most are also tried as one: what was put in or left out.
WIDEN = 4
MATCH, MISMATCH, GAP = 2, -1, -1
MAX_TEMPLATE_WORDS = 200_000
#: Wordings by which licenses are commonly named or granted, and whole texts of the short ones.
MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
MIT_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEMPLATES = {
    "mit/notice": "Released under the MIT License.",
    "mit/grant": MIT_GRANT,
    "apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0/header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "gpl-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-or-later/header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0-or-later/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-nc-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0/notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd/conditions": BSD_GRANT,
    "mpl-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "isc/grant": ISC_GRANT,
    "unlicense/notice": "This is free and unencumbered software released into the public domain.",
    "lgpl-2.1-or-later/header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3.0-or-later/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-nd-4.0/notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc0-1.0/notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "mit/text": MIT_GRANT + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + MIT_WARRANTY,
    "isc/text": ISC_GRANT + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "bsd-2-clause/text": f"{BSD_GRANT} 1. {BSD_SOURCE} 2. {BSD_BINARY} {BSD_DISCLAIMER}",
    "bsd-3-clause/text": f"{BSD_GRANT} 1. {BSD_SOURCE} 2. {BSD_BINARY} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {BSD_DISCLAIMER}",
    "zlib/text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}

_TABLE = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """ASCII letters (lower-cased), digits and what is not ASCII make words."""
    return (text or "").encode().translate(_TABLE).split()


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int, int]:
    """The best local alignment in which template place i meets text place i + low to i + high: score, matched words, first and last + 1 word of the text. Ties: the first found, by template then text."""
    wide = high - low + 1
    # Of each diagonal: score, matched words, first text word.
    above = [(0, 0, 0)] * (wide + 1)
    best = (0, 0, 0, 0)
    text_at, n = text.tolist(), len(text)
    for i, word in enumerate(template.tolist()):
        row, left = [], (0, 0, 0)
        for d in range(wide):
            j = i + low + d
            if not 0 <= j < n:
                row.append((0, 0, 0))
                left = (0, 0, 0)
                continue
            score, matched, first = above[d]
            here = (score + MATCH, matched + 1, first if score else j) if word == text_at[j] and word else (score + MISMATCH, matched, first)
            if above[d + 1][0] + GAP > here[0]:
                here = (above[d + 1][0] + GAP, *above[d + 1][1:])
            if left[0] + GAP > here[0]:
                here = (left[0] + GAP, *left[1:])
            if here[0] <= 0:
                here = (0, 0, 0)
            elif here[0] > best[0]:
                best = (here[0], here[1], here[2], j + 1)
            row.append(here)
            left = here
        above = [*row, (0, 0, 0)]
    return best


class LicenseIndex:
    def __init__(self, templates: dict[str, str], band: int = BAND, least: float = LEAST_COVERAGE):
        self.names, self.band, self.least = list(templates), band, least
        each = [words_of(t) for t in templates.values()]
        if sum(map(len, each)) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"the templates have more than {MAX_TEMPLATE_WORDS} words")
        if short := [name for name, words in zip(self.names, each, strict=True) if len(words) < GRAM]:
            raise ValueError(f"templates need {GRAM} words: {', '.join(short)}")
        self.ids = {w: i + 1 for i, w in enumerate(sorted(set().union(*each)))}
        self.templates = [np.array([self.ids[w] for w in ws], np.int64) for ws in each]
        self.base = len(self.ids) + 1
        self.counts = [np.bincount(ids, minlength=self.base) for ids in self.templates]
        index: dict[int, list[tuple[int, int]]] = {}
        for t, ids in enumerate(self.templates):
            grams = [tuple(ids[i : i + GRAM].tolist()) for i in range(len(ids) - GRAM + 1)]
            hashes = [xxhash.xxh64_intdigest(repr(g)) for g in grams]
            for start in range(max(len(grams) - WINDOW + 1, min(len(grams), 1))):
                window = range(start, min(start + WINDOW, len(grams)))
                at = min(window, key=lambda i: (hashes[i], i))
                code = self._codes(np.array(grams[at]))[0]
                if (t, at) not in index.setdefault(int(code), []):
                    index[int(code)].append((t, at))
        self.codes = np.array(sorted(index), np.int64)
        self.places = [index[int(c)] for c in self.codes]

    def _codes(self, ids: np.ndarray) -> np.ndarray:
        return (ids[:-2] * self.base + ids[1:-1]) * self.base + ids[2:]

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, lowest, highest diagonal) from the index's hits."""
        if len(ids) < GRAM or not len(self.codes):
            return []
        at = np.flatnonzero((ids[:-2] > 0) & (ids[1:-1] > 0) & (ids[2:] > 0))
        codes = (ids[at] * self.base + ids[at + 1]) * self.base + ids[at + 2]
        slot = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        hit = self.codes[slot] == codes
        diagonals = sorted({(t, int(p) - place) for p, s in zip(at[hit], slot[hit], strict=True) for t, place in self.places[s]})
        narrow: list[tuple[int, int, int]] = []
        for t, d in diagonals:
            if narrow and narrow[-1][0] == t and d - narrow[-1][1] <= self.band:
                narrow[-1] = (t, narrow[-1][1], d)
            else:
                narrow.append((t, d, d))
        out = []
        for i, (t, low, high) in enumerate(narrow):
            out.append((t, low, high))
            for u, _, further in narrow[i + 1 :]:  # at most as many as fit into the wider band
                if u != t or further - low > len(self.templates[t]) // WIDEN:
                    break
                high = further
            if high > out[-1][2]:
                out.append((t, low, high))
        return out

    def matches(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, matched words, first word, last word + 1), by template and place."""
        ids = np.fromiter(map(self.ids.get, words_of(text), repeat(0)), np.int64)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for t, low, high in self.candidates(ids):
            template = self.templates[t]
            if 0 <= low == high and np.array_equal(ids[low : low + len(template)], template):
                found.setdefault(t, []).append((len(template), low, low + len(template)))
                continue
            begin = max(low - self.band, 0)
            part = ids[begin : high + self.band + len(template)].copy()
            # Again without the words just matched, while enough of the template's words are left.
            while np.minimum(np.bincount(part, minlength=self.base), self.counts[t])[1:].sum() >= self.least * len(template):
                _, matched, first, last = align(template, part, low - self.band - begin, high + self.band - begin)
                if not matched or matched < self.least * len(template):
                    break
                found.setdefault(t, []).append((matched, first + begin, last + begin))
                part[first:last] = 0
        out = []
        for t, each in sorted(found.items()):
            kept: list[tuple[int, int, int]] = []
            for m in sorted(set(each), key=lambda m: (-m[0], m[1])):
                if all(m[1] >= k[2] or m[2] <= k[1] for k in kept):
                    kept.append(m)
            out += [(self.names[t], matched / len(self.templates[t]), matched, first, last) for matched, first, last in sorted(kept, key=lambda m: m[1])]
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, band: int = BAND, least: float = LEAST_COVERAGE) -> DataFrame:
    """doc_id, template, license, coverage, matched_words, first_word, end_word of each match."""
    templates = TEMPLATES if templates is None else templates
    LicenseIndex(templates, band, least)

    @trimmed
    def run(batches):
        index = LicenseIndex(templates, band, least)
        for batch in batches:
            rows = [(i, *m) for i, text in enumerate(batch.column(1).to_pylist()) for m in index.matches(text)]
            if rows:
                at, names, coverage, matched, first, end = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(names), pa.array([n.partition("/")[0] for n in names]), pa.array(coverage), *(pa.array(x, pa.int64()) for x in (matched, first, end))],
                    ["doc_id", "template", "license", "coverage", "matched_words", "first_word", "end_word"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, template string, license string, coverage double, matched_words long, first_word long, end_word long")
