"""6. License scans by patience alignment.

A text is aligned with a license template the way patience diff does it: words that stand once in both are anchors,
the longest increasing subsequence of them holds, and the gaps between are aligned in the same way. Coverage is the
share of the template's words that the alignment matches; words that the template doesn't have take no part.

A word that a text repeats is no anchor, so a text is aligned in windows: of twice the template's length, overlapping by
half, then of twice that, and so on to the whole text. How far a find's words may lie apart follows from how many match:
two words more in common allow about 1.4 times the spread. Five words in order are worth little over a long text, fifty
prove a license however much stands between them. Windows that hold too few of a template's words are passed over,
which passes over none that could reach the coverage.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch_of, ids_of, map_steps, narrow, texts_of
from tidemark.llm.decontaminate import words_of

COVERAGE = 0.8

# fixed values: public license notices
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY"
    " AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR"
    " CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY"
    " OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF"
    " SUCH DAMAGE."
)
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-line": "Released under the MIT License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS,"
        " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without"
        " restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom"
        " the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions"
        " of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A"
        " PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,"
        " TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"
        " of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of"
        " MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with"
        " this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "LGPL-2.1-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either"
        " version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied"
        " warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General"
        " Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
    ),
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either"
        " version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied"
        " warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General"
        " Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission"
        " notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY"
        " AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,"
        " WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must"
        " retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of"
        " conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. " + _BSD_END
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must"
        " retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of"
        " conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its"
        " contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END
    ),
}


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tails, ends, back = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect.bisect_left(tails, v)
        back[i] = ends[k - 1] if k else -1
        tails[k : k + 1], ends[k : k + 1] = [v], [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places (in a, in b), increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        often_a, often_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: k for k, w in enumerate(b[b0:b1], b0) if often_b[w] == 1}
        pairs = [(k, place[w]) for k, w in enumerate(a[a0:a1], a0) if often_a[w] == 1 and w in place]
        anchors = [pairs[k] for k in longest_increasing([q for _, q in pairs])]
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str):
        self.name = name
        self.words = words_of(pa.array([text]))[4].tolist()
        self.counts = Counter(self.words)


def spread(matched: int, size: int) -> float:
    """Words of a text that a match of so many of a template's ``size`` words may span."""
    return size * 2.0 ** min(matched / 4, 60)


def windows_of(last: int, size: int) -> Iterator[tuple[int, int]]:
    """The windows (first word, last word + 1) that a text of ``last`` words is aligned in with a template of ``size``: from
    twice the template's length on, each width twice the one before, until one holds the text or no match may span it."""
    width = 2 * size
    while True:
        yield from ((a, a + width) for a in range(0, max(last - width // 2, 1), width // 2))
        if width >= last or width >= 2 * spread(size, size):
            return
        width *= 2


def find_in(words: list, templates: list[Template], coverage: float = COVERAGE) -> list[tuple[str, float, int, int]]:
    """(template, coverage, first word, last word + 1) of each find in a text's word hashes."""
    return find_among(list(range(len(words))), words, len(words), templates, coverage)


def find_among(places: list[int], letters: list, last: int, templates: list[Template], coverage: float = COVERAGE) -> list[tuple[str, float, int, int]]:
    """As ``find_in``, for a text of ``last`` words of which ``letters`` stand at ``places``; the others are in no template.
    Of finds of one template that overlap the best stays; of different templates those stay of which no more than half
    lies in finds of more weight: matched words times coverage."""
    found = []
    for t in templates:
        at = [k for k, w in enumerate(letters) if w in t.counts]
        mine, words = [places[k] for k in at], [letters[k] for k in at]
        need, matches = coverage * len(t.words) - 1e-9, set()
        for first, end in windows_of(last, len(t.words)):
            a, b = bisect.bisect_left(mine, first), bisect.bisect_left(mine, end)
            if b - a < need or sum(min(n, t.counts[w]) for w, n in Counter(words[a:b]).items()) < need:
                continue
            match = patience(words[a:b], t.words)
            if len(match) >= need:
                begin, stop = mine[a + match[0][0]], mine[a + match[-1][0]] + 1
                if stop - begin <= spread(len(match), len(t.words)):
                    matches.add((len(match), begin, stop))
        for n, a, b in sorted(matches, key=lambda m: (-m[0], m[2] - m[1], m[1])):
            if all(b <= c or d <= a for _, name, c, d in found if name == t.name):
                found.append((n, t.name, a, b))
    size, kept = {t.name: len(t.words) for t in templates}, []
    for f in sorted(found, key=lambda f: (f[0] * f[0] / size[f[1]], f[0], f[1]), reverse=True):
        inside, reached = 0, f[2]
        for _, _, a, b in sorted(kept, key=lambda g: g[2]):
            inside += max(min(b, f[3]) - max(a, reached), 0)
            reached = max(reached, b)
        if 2 * inside <= f[3] - f[2]:
            kept.append(f)
    return sorted(((name, n / size[name], a, b) for n, name, a, b in kept), key=lambda x: (x[2], x[0]))


FOUND = "array<struct<license:string,coverage:double,start:long,end:long>>"


def scan(docs: DataFrame, templates: Mapping[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """The operator: (doc_id, found) for each row of ``docs``: finds with their words' numbers, in the order of the text.

    Words are runs of letters and digits, A-Z in lower case. Null and empty texts have no finds. Templates are small
    and go with the task. Repeated rows repeat; further columns are ignored; an empty table gives no rows.
    """
    known = [Template(k, v) for k, v in (TEMPLATES if templates is None else templates).items()]
    known = [t for t in known if t.words]
    vocabulary = np.unique(np.array([w for t in known for w in t.words], np.uint64))
    needs = [(t, np.searchsorted(vocabulary, np.array(list(t.counts), np.uint64)), np.array(list(t.counts.values()))) for t in known]
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        block, _, _, doc, hashes = words_of(texts_of(batch))
        found: list[list] = [[] for _ in range(block.n)]
        if len(hashes) and len(vocabulary):
            letter = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            hit = vocabulary[letter] == hashes
            held = np.bincount(doc[hit] * len(vocabulary) + letter[hit], minlength=block.n * len(vocabulary)).reshape(block.n, -1)
            first = np.searchsorted(doc, np.arange(block.n + 1))
            maybe: dict[int, list[Template]] = {}
            for t, at, count in needs:  # the most that an alignment could match
                for d in np.flatnonzero(np.minimum(held[:, at], count).sum(axis=1) >= coverage * len(t.words) - 1e-9).tolist():
                    maybe.setdefault(d, []).append(t)
            for d, some in maybe.items():
                mine = np.flatnonzero(hit[first[d] : first[d + 1]])
                finds = find_among(mine.tolist(), hashes[first[d] + mine].tolist(), int(first[d + 1] - first[d]), some, coverage)
                found[d] = [dict(zip(("license", "coverage", "start", "end"), f, strict=True)) for f in finds]
        return batch_of(doc_id=ids_of(batch), found=pa.array(found, kind))

    return map_steps(narrow(docs, "doc_id", "text"), work, f"doc_id long, found {FOUND}")


def digest(docs: DataFrame) -> DataFrame:
    """op6's rows: per document the number of finds, the licenses, and the finds with coverage in percent."""
    told = F.transform("found", lambda f: F.concat_ws(":", f["license"], f["start"], f["end"], F.round(100 * f["coverage"]).cast("int")))
    return scan(docs).select("doc_id", F.size("found").cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda f: f["license"]))), ",").alias("licenses"), F.array_join(told, ",").alias("finds"))
