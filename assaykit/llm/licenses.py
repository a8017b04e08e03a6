"""License scans by patience alignment.

Text and template are sequences of lower-case words without punctuation. Words that occur once in
each are anchors; the longest increasing run of anchors (patience sorting) is kept, and the gaps
between neighbouring anchors are aligned in the same way, where words that were repeated in the
whole may be unique. A gap without anchors is matched by its equal words from both ends. The
template's coverage is the part of its words that are aligned. A text is aligned around each
place where enough of a template's words stand within the template's length, so that a notice
inside a long text is found as well as one alone.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.functions.ship import map_batches

_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_GNU_REST = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'
_MIT_REST = ', and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_APACHE_REST = ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = ": Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_REST = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES'
_CC = "This work is licensed under a Creative Commons {} International License."
#: Notices by licence.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", _APACHE, _APACHE + _APACHE_REST),
    "MIT": ("Released under the MIT License.", _MIT, _MIT + _MIT_REST),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", _GNU.format("General Public License", 3), (_GNU + _GNU_REST).format("General Public License", 3)),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", (_GNU + _GNU_REST).format("General Public License", 2)),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", (_GNU + _GNU_REST).format("Lesser General Public License", 3)),
    "LGPL-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1.", (_GNU + _GNU_REST).format("Lesser General Public License", 2.1)),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", (_GNU + _GNU_REST).format("Affero General Public License", 3)),
    "MPL-2.0": ("Released under the Mozilla Public License 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "EPL-2.0": ("Released under the Eclipse Public License 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    "BSD-3-Clause": (_BSD, _BSD + _BSD_TWO + _BSD_NAME, _BSD + _BSD_TWO + _BSD_NAME + _BSD_REST),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", _BSD + _BSD_TWO + _BSD_REST),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt"),
    "Unlicense": ("Released into the public domain under the Unlicense.", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", _CC.format("Attribution-NonCommercial 4.0")),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", _CC.format("Attribution 4.0")),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", _CC.format("Attribution-ShareAlike 4.0")),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", _CC.format("Attribution-NoDerivatives 4.0")),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
}
COVERAGE = 0.8
_PUNCTUATION = bytes(i if chr(i).isalnum() or i > 127 else 32 for i in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.lower().translate(_PUNCTUATION).split()


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        if p == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[p], piles[p] = v, i
        back[i] = piles[p - 1] if p else -1
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience_align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Aligned (index in a, index in b), increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {w: i for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1}
        anchors = [(at[w], j) for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and w in at]
        chain = [anchors[i] for i in longest_increasing([i for i, _ in anchors])]
        if not chain:
            continue
        ends = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        out += chain
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:]) if k > i + 1 and m > j + 1]
    return sorted(out)


class Templates:
    def __init__(self, templates: dict[str, tuple[str, ...]], coverage: float):
        self.coverage = coverage
        self.all = [(name, words_of(t.encode())) for name, texts in templates.items() for t in texts]
        self.counts = [Counter(w) for _, w in self.all]
        self.vocabulary = {w for _, words in self.all for w in words}

    def places(self, words: list[bytes], known: list[int], k: int) -> list[tuple[int, int]]:
        """Windows of words in which template k can reach its coverage: each stretch of twice the
        template's length with enough of its words, merged where they overlap, and each least stretch
        with enough of them and as many words around it as may be missing, so that a notice that is
        there twice is aligned alone as well. ``known`` are the positions of words of any template."""
        need, counts, n = self.coverage * len(self.all[k][1]), self.counts[k], len(self.all[k][1])
        own = [i for i in known if words[i] in counts]
        out: list[list[int]] = []
        have: Counter = Counter()
        total = left = 0
        for i in own:
            have[words[i]] += 1
            total += have[words[i]] <= counts[words[i]]
            while own[left] <= i - 2 * n:
                w = words[own[left]]
                total -= have[w] <= counts[w]
                have[w] -= 1
                left += 1
            if total >= need:
                if out and own[left] <= out[-1][1]:
                    out[-1][1] = i + 1
                else:
                    out.append([own[left], i + 1])
        merged = [(a, b) for a, b in out]
        slack = n - int(need)
        have, total, left = Counter(), 0, 0
        least = set()
        for i in own:
            have[words[i]] += 1
            total += have[words[i]] <= counts[words[i]]
            while total >= need:
                w, at = words[own[left]], own[left]
                total -= have[w] <= counts[w]
                have[w] -= 1
                left += 1
                if total < need and i - at < 2 * n:
                    least.add((max(0, at - slack), min(len(words), i + 1 + slack)))
        return merged + sorted(least - set(merged))

    def notices(self, raw: bytes):
        """(licence, coverage, first word, last word + 1) of the notices in a text that don't overlap,
        the best first: more aligned words win, then the greater coverage, then the template named
        first, then the shorter place, then the one that comes first."""
        words = words_of(raw)
        there = self.vocabulary.intersection(words)
        # a template can reach its coverage only if enough of its words are in the text at all
        able = [k for k, c in enumerate(self.counts) if sum(c[w] for w in c if w in there) >= self.coverage * len(self.all[k][1])]
        if not able:
            return []
        known = [i for i, w in enumerate(words) if w in there]
        found = set()
        for k in able:
            template = self.all[k][1]
            for a, b in self.places(words, known, k):
                pairs = patience_align(words[a:b], template)
                if pairs and len(pairs) / len(template) >= self.coverage:
                    first, last = a + pairs[0][0], a + pairs[-1][0] + 1
                    found.add((-len(pairs), len(template), k, last - first, first, last))
        out = []
        for pairs, _, k, _, first, last in sorted(found):
            if all(last <= a or first >= b for _, _, a, b in out):
                out.append((self.all[k][0], -pairs / len(self.all[k][1]), first, last))
        return out


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, tuple[str, ...]] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, first_word, last_word, notices): the notice best covered in each
    whole text, and all that don't overlap as licence:first_word:last_word, in order of place.

    license is null, coverage 0 and the positions null where no template reaches ``coverage``, as in
    null and empty texts. Positions count words, last_word is inclusive. A row per row of docs.
    """
    known = Templates(TEMPLATES if templates is None else templates, coverage)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        from assaykit.llm.common import binary_column

        for batch in batches:
            hits = [known.notices(raw) for raw in binary_column(batch, "text").to_pylist()]
            every = [",".join(f"{name}:{a}:{b - 1}" for name, _, a, b in sorted(h, key=lambda x: x[2])) for h in hits]
            hits = [h[0] if h else (None, 0.0, None, None) for h in hits]
            names, shares, first, last = zip(*hits) if hits else ((), (), (), ())
            cols = [pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(first, pa.int64()), pa.array([x and x - 1 for x in last], pa.int64()), pa.array(every, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "license", "coverage", "first_word", "last_word", "notices"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_batches(rows, run, f"doc_id {kind}, license string, coverage double, first_word bigint, last_word bigint, notices string")
