"""License scans by conditional compression.

A candidate block reaches from a licensing word as many words to both sides as the
longest window has, over line ends, white space and comment marks; so a notice may
be wrapped over lines. Blocks that overlap are one. Each window of a block of about a
template's length is held against the template word by word: the longest common
subsequence must hold at least `WORDING` of the template's words and no more than
`EXTRA` other words may stand between them. Only windows that lack too many of the
template's words in any order are skipped, which loses nothing. Windows are compressed,
their words joined by single spaces, with their template as a raw zstandard dictionary.
Those that save most bytes against no dictionary come first, then those with most matched
words less differing ones; so a license text isn't taken for the notice that it begins
with. The reduction is the share of bytes saved; text around a notice, line ends and
comment marks don't change it. The words that differ are reported.

All templates, short notices and whole license texts, are tried, and every match is
reported whose matched words no better one has. A template that
matches several times on a line is reported once, by its best match there. A match
belongs to the line of its first matched word; `blocks` counts the lines on which
a licensing word begins.

Defined results: null text, empty text and text without a candidate have no
blocks and no licenses. Rows are judged one by one, so repeats and null ids
change nothing. Empty tables give empty results. An input column named like the
result column is replaced.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import vectext as V
from .common import table, with_struct, without

# The level's parser is an optimal one; faster levels' sizes of texts this short vary by their match finders' hits.
LEVEL = 19
WORDING = 0.8
EXTRA = 0.35

# Short notices by which public licenses are applied, and whole texts of such licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}

CANDIDATE = re.compile(r"licen[cs]|copyright|permission|redistribut|public\W+domain|spdx", re.I | re.A)
_RUN = re.compile(r"[\w.+-]+")

RESULT = T.StructType([
    T.StructField("blocks", T.LongType()),
    T.StructField("found", T.ArrayType(T.StructType([T.StructField("line", T.LongType()), T.StructField("license", T.StringType()), T.StructField("reduction", T.DoubleType()), T.StructField("missing", T.ArrayType(T.StringType())), T.StructField("extra", T.ArrayType(T.StringType()))]))),
])


def spans(text: str, first: int = 0, after: int | None = None) -> list[tuple[int, int]]:
    """Where the words of a stretch begin and end: runs of word characters and .+- up to the last word character."""
    out = []
    for m in _RUN.finditer(text, first, len(text) if after is None else after):
        if w := m.group().rstrip(".+-"):
            out.append((m.start(), m.start() + len(w)))
    return out


def words(text: str) -> list[str]:
    return [text[a:b].lower() for a, b in spans(text)]


def wording(template: list[str], block: list[str]) -> tuple[list[str], list[int], list[int]]:
    """(missing words, places of words in between, places of common words) by a longest common subsequence."""
    n, m = len(template), len(block)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if template[i] == block[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    missing, common = [], []
    while i < n and j < m:
        if template[i] == block[j]:
            common.append(j)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            missing.append(template[i])
            i += 1
        else:
            j += 1
    inside = set(common)
    return missing + template[i:], [j for j in range(common[0], common[-1]) if j not in inside] if common else [], common


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.known, self.marks, self.holders = [], [], {}
        for name, text in templates.items():
            ws, marks = words(text), {}
            raw = zstandard.ZstdCompressionDict(" ".join(ws).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            for i, w in enumerate(ws):
                marks[w] = marks.get(w, 0) | 1 << i
            for w in marks:
                self.holders.setdefault(w, []).append(len(self.known))
            self.known.append((name, ws, zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_dict_id=False)))
            self.marks.append(marks)
        self.reach = max((self.longest(len(ws)) for _, ws, _ in self.known), default=0)

    @staticmethod
    def longest(n: int) -> int:
        """Words of the longest window that a template of n words can be confirmed in."""
        return n + int(EXTRA * n)

    def starts(self, own: list[str]) -> list[tuple[int, int]]:
        """(template, first word) of all windows that hold enough of a template's words, in any order."""
        places, out = {}, []
        for i, w in enumerate(own):
            for t in self.holders.get(w, ()):
                places.setdefault(t, []).append(i)
        for t, at in places.items():
            n, marks = len(self.known[t][1]), self.marks[t]
            have, total, j = dict.fromkeys(marks, 0), 0, 0
            if len(at) < WORDING * n:
                continue
            for i in at:
                while j < len(at) and at[j] < i + self.longest(n):
                    total += have[own[at[j]]] < marks[own[at[j]]].bit_count()
                    have[own[at[j]]] += 1
                    j += 1
                if total >= WORDING * n:
                    out.append((t, i))
                have[own[i]] -= 1
                total -= have[own[i]] < marks[own[i]].bit_count()
        return out

    def window(self, t: int, own: list[str | None], first: int) -> tuple[int, int] | None:
        """(matched words less differing ones, end) of the best confirmed window from `first`."""
        n, marks, best = len(self.known[t][1]), self.marks[t], None
        v = full = (1 << n) - 1
        for at in range(first, min(first + self.longest(n), len(own))):
            if m := marks.get(own[at]):
                # One step of the longest common subsequence; its length is the number of zeros.
                v = (v + (v & m) | v & ~m) & full
                common = n - v.bit_count()
                extra = at + 1 - first - common
                if common >= WORDING * n and extra <= EXTRA * n and (best is None or 2 * common - n - extra > best[0]):
                    best = 2 * common - n - extra, at + 1
        return best

    def matches(self, text: str, at: list[tuple[int, int]]) -> list[tuple[int, str, float, list[str], list[str]]]:
        """(place, license, reduction, missing, extra) of all matches among the words at `at`.

        The best is taken first; its words then count for no other match.
        """
        own = [text[a:b].lower() for a, b in at]
        free, heap, out = list(own), [], []

        def offer(t: int, first: int) -> None:
            if hit := self.window(t, free, first):
                name, _, compressor = self.known[t]
                block = " ".join(own[first : hit[1]]).encode()
                alone = len(self.plain.compress(block))
                saved = alone - len(compressor.compress(block))
                heapq.heappush(heap, (-saved, -hit[0], name, first, hit[1], t, saved / alone))

        for t, first in self.starts(own):
            offer(t, first)
        while heap:
            _, worse, name, first, after, t, gain = heapq.heappop(heap)
            # A window that lost words to a better match since comes back with what it has left.
            if self.window(t, free, first) != (-worse, after):
                offer(t, first)
                continue
            missing, between, common = wording(self.known[t][1], free[first:after])
            out.append((at[first + common[0]][0], name, gain, missing, [own[first + j] for j in between]))
            for j in common:
                free[first + j] = None
        return out

    def best(self, block: bytes) -> tuple[str, float, list[str], list[str]] | None:
        """The best confirmed template."""
        text = block.decode(errors="replace")
        found = self.matches(text, spans(text))
        return found[0][1:] if found else None

    def stretches(self, text: str) -> tuple[list[list[int]], int]:
        """Where the blocks begin and end, those that overlap as one; lines on which a licensing word begins."""
        out, lines, line_end = [], 0, -1
        for x in CANDIDATE.finditer(text):
            if x.start() > line_end:
                lines += 1
                line_end = text.find("\n", x.start())
                line_end = len(text) if line_end < 0 else line_end
            left, after = self.reach, x.end()
            for m in _RUN.finditer(text, x.end()):
                left -= bool(m.group().strip(".+-"))
                after = m.end()
                if left < 0:  # one more, as the first may be the rest of the licensing word
                    break
            if out and x.start() <= out[-1][1]:
                out[-1][1] = max(after, out[-1][1])
                continue
            size = 16 * self.reach
            while True:
                low = max(0, x.start() - size)
                before = spans(text, low, x.start())
                if not low or len(before) > self.reach + 1:
                    break
                size *= 2
            # The earliest one may be the rest of a word, unless it is the text's first; the last may belong to the licensing word.
            first = 0 if not low else before[-self.reach - 1][0]
            if out and first <= out[-1][1]:
                out[-1][1] = max(after, out[-1][1])
            else:
                out.append([first, after])
        return out, lines

    def text(self, text: str | None) -> dict:
        text, found = text or "", []
        stretches, blocks = self.stretches(text)
        line = at = 0
        for first, after in stretches:
            for place, name, gain, missing, extra in self.matches(text, spans(text, first, after)):
                found.append((place, len(missing) + len(extra), {"license": name, "reduction": gain, "missing": missing, "extra": extra}))
        once = {}
        for place, differing, f in sorted(found, key=lambda x: x[:2]):
            line += text.count("\n", at, place)
            at = place
            if (line, f["license"]) not in once or differing < once[line, f["license"]][0]:
                once[line, f["license"]] = differing, {"line": line, **f}
        return {"blocks": blocks, "found": [f for _, f in once.values()]}


def scan_licenses(docs: DataFrame, *, text: str = "text", templates: dict[str, str] | None = None, into: str = "licenses") -> DataFrame:
    """docs with a struct column `into`: blocks and found (line, license, reduction, missing, extra)."""
    templates = dict(templates or TEMPLATES)
    docs = without(docs, into)
    schema = with_struct(docs.schema, into, RESULT)

    def go(batches):
        arrow, scanner = to_arrow_schema(schema), Scanner(templates)
        for batch in batches:
            for part in V.slices(batch, text):
                made = [scanner.text(t) for t in part.column(text).to_pylist()]
                cols = [pa.array(made, arrow.field(into).type) if f.name == into else part.column(f.name) for f in schema.fields]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return docs.mapInArrow(go, schema)


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    x = F.col("licenses")
    names = F.array_sort(F.array_distinct(x.found.license))
    differing = F.aggregate(x.found, F.lit(0).cast("long"), lambda a, f: a + F.size(f["missing"]) + F.size(f["extra"]))
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", x.blocks.alias("n_blocks"), F.size(x.found).cast("long").alias("n_found"), F.concat_ws(",", names).alias("licenses"), F.coalesce(F.array_max(x.found.reduction), F.lit(0.0)).alias("best_reduction"), differing.alias("n_differing_words")
    )
