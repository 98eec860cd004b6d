"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

A text is compared as a whole and by its paragraphs (between blank lines), lines and sentences. Words are runs of
digits, letters and what is not ASCII, A-Z in lower case; a unit's set is its distinct bigrams. With a and b bigrams,
Dice is at most 2 min(a, b) / (a + b), so a template of b bigrams can reach the threshold t only for units with
b t / (2 - t) to b (2 - t) / t of them: other templates are pruned by size, and those that share no bigram are never
looked at.

A licence that no unit matches is looked for in windows of consecutive pieces (lines, cut at sentence ends), so wording
may be wrapped, parted by blank lines or followed by more. Such a window shares at least t b / (2 - t) of a template's
bigrams, so only texts that do are gone through. The best window of each name counts once, unless a window of another
name that overlaps it scores higher.

A unit names the licence whose template it reaches best, so versions that differ in one word aren't mixed up. Some
names depend on what else stands in the document: a licence's third clause turns BSD-2-Clause into BSD-3-Clause, and
reserved rights are only proprietary where no licence grants any (`settled`).

Defined cases: null and empty texts, and units of one word, match nothing; a document with several licences has them
all; equal units count once; ties in score go to the name first in order; rows with a null doc_id and repeated rows
get a row each; without templates nothing matches; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import ALNUM, frugal, slices, tidy

THRESHOLD = 0.8
SLICE_BYTES = 4 << 20

#: The wording of licences and of the notices that refer to them.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause/clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
#: The identifiers of short tags, by the name they stand for.
SPDX = {
    "MIT": "MIT", "ISC": "ISC", "Apache-2.0": "Apache-2.0", "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause", "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0",
    "GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0", "LGPL-2.1-only": "LGPL-2.1", "LGPL-2.1-or-later": "LGPL-2.1", "LGPL-3.0-only": "LGPL-3.0", "LGPL-3.0-or-later": "LGPL-3.0",
    "AGPL-3.0-only": "AGPL-3.0", "AGPL-3.0-or-later": "AGPL-3.0", "MPL-2.0": "MPL-2.0", "CC-BY-4.0": "CC-BY-4.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC-BY-NC-4.0": "CC-BY-NC-4.0",
    "CC-BY-ND-4.0": "CC-BY-ND-4.0", "CC0-1.0": "CC0-1.0", "Unlicense": "Unlicense",
}
TEMPLATES += [(name, f"SPDX-License-Identifier: {tag}") for tag, name in SPDX.items()]
#: A clause that stands for a longer licence: its name, and the shorter licence that it then isn't.
CLAUSES = {"BSD-3-Clause/clause": ("BSD-3-Clause", "BSD-2-Clause")}
#: Reserved rights say nothing beside a licence.
ONLY_ALONE = "proprietary"

PARAGRAPH = re.compile(r"\n[ \t\r\f\v]*\n")
PIECE = re.compile(r"[^\n]+?(?:(?<=[.!?])(?= )|(?=\n)|\Z)")
SENTENCE = re.compile(r"(?<=[.!?]) +")


Match = tuple[str, float, str, str]


def settled(found: list[Match]) -> list[Match]:
    """The matches of a document after those decided that hang on others."""
    names = {m[0] for m in found}
    gone = {short for clause, (_, short) in CLAUSES.items() if clause in names}
    if names - {ONLY_ALONE}:
        gone.add(ONLY_ALONE)
    return [(CLAUSES.get(m[0], (m[0],))[0], *m[1:]) for m in found if m[0] not in gone]


def bigrams(text: str) -> set[tuple[bytes, bytes]]:
    words = text.encode().translate(ALNUM).split()
    return set(zip(words, words[1:], strict=False))


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], threshold: float = THRESHOLD):
        self.names = [name for name, _ in templates]
        self.threshold = threshold
        self.sizes, self.holders = [], {}
        for k, (_, text) in enumerate(templates):
            own = bigrams(text)
            self.sizes.append(len(own))
            for pair in own:
                self.holders.setdefault(pair, []).append(k)
        # Sizes of units that some template can reach.
        t = threshold
        self.bounds = [(b * t / (2 - t) - 1e-9, b * (2 - t) / t + 1e-9) for b in self.sizes]
        self.most = int(max((high for _, high in self.bounds), default=0))

    def unit(self, text: str) -> list[tuple[str, float]]:
        """Name of the template that the unit reaches best, with Dice; at most one."""
        # A unit with too many spaces has too many words for any template, unless words repeat.
        own = bigrams(text)
        n = len(own)
        if not n or n > self.most:
            return []
        shared: dict[int, int] = {}
        for pair in own & self.holders.keys():
            for k in self.holders[pair]:
                low, high = self.bounds[k]
                if low <= n <= high:
                    shared[k] = shared.get(k, 0) + 1
        found = [(-2 * both / (n + self.sizes[k]), self.names[k]) for k, both in shared.items()]
        return [(name, -dice) for dice, name in sorted(found)[:1] if -dice >= self.threshold]

    def windows(self, text: str, known: set[str]) -> list[Match]:
        """The best window of consecutive pieces for each licence that isn't known yet, unless another's overlaps it and is better."""
        met: dict[int, int] = {}
        for pair in bigrams(text) & self.holders.keys():
            for k in self.holders[pair]:
                met[k] = met.get(k, 0) + 1
        left = {k for k, n in met.items() if n >= self.bounds[k][0]}
        if {self.names[k] for k in left} <= known:
            return []
        most = max(self.bounds[k][1] for k in left)
        pieces = [(m.start(), m.end(), m[0].encode().translate(ALNUM).split()) for m in PIECE.finditer(text)]
        pieces = [x for x in pieces if x[2]]
        best: dict[str, tuple[float, int, int]] = {}
        for i, (begin, _, _) in enumerate(pieces):
            own, last, shared = set(), None, dict.fromkeys(left, 0)
            for _, end, words in pieces[i:]:
                for pair in zip([last, *words] if last else words, words if last else words[1:], strict=False):
                    if pair not in own:
                        own.add(pair)
                        for k in self.holders.get(pair, ()):
                            if k in left:
                                shared[k] += 1
                last = words[-1]
                if len(own) > most:
                    break
                for k, both in shared.items():
                    dice = 2 * both / (len(own) + self.sizes[k])
                    if dice >= self.threshold and dice > best.get(self.names[k], (0.0,))[0]:
                        best[self.names[k]] = (dice, begin, end)
                if all(both == self.sizes[k] for k, both in shared.items()):
                    break
        out: list[tuple[str, float, int, int]] = []
        for name, (dice, begin, end) in sorted(best.items(), key=lambda x: (-x[1][0], x[0])):
            if all(end <= a or b <= begin for _, _, a, b in out):
                out.append((name, dice, begin, end))
        return sorted((name, dice, "window", text[begin:end]) for name, dice, begin, end in out if name not in known)

    def __call__(self, text: str | None) -> list[tuple[str, float, str, str]]:
        """name, Dice, kind of unit and unit, for all units of the text that match; nested equal units once."""
        if not text:
            return []
        out, seen = [], set()
        for kind, units in (("text", [text]), ("paragraph", PARAGRAPH.split(text)), ("line", text.split("\n")), ("sentence", [s for x in text.split("\n") for s in SENTENCE.split(x)])):
            for unit in units:
                if unit in seen:
                    continue
                seen.add(unit)
                out += [(name, dice, kind, unit) for name, dice in self.unit(unit)]
        return settled(out + self.windows(text, {name for name, *_ in out}))


def matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document row: doc_id and matches (licence, score, kind, unit) of its distinct units."""
    frugal(docs.sparkSession)
    kind = pa.list_(pa.struct([("licence", pa.string()), ("score", pa.float64()), ("kind", pa.string()), ("unit", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(templates, threshold)
        for part in (x for b in batches for x in slices(b, "text", SLICE_BYTES)):
            found = [[dict(zip(("licence", "score", "kind", "unit"), m, strict=True)) for m in scan(t)] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind)], names=["doc_id", "matches"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, matches array<struct<licence:string,score:double,kind:string,unit:string>>")


def licences(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document row: doc_id, licences (names in order, comma-joined), best_score, n_matches."""
    found = matches(docs, templates, threshold)
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"])))
    return found.select("doc_id", F.array_join(names, ",").alias("licences"), F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)), 6).alias("best_score"), F.size("matches").cast("long").alias("n_matches"))
