"""Finding licence texts in documents by patience alignment."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: The share of a template's words that must be found in order.
COVERAGE = 0.8
#: Gaps without a word unique to both sides are aligned word by word up to this many pairs.
SMALL_GAP = 400

#: Notices and licence texts to look for, by their SPDX names.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-header": """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See
        the License for the specific language governing permissions and limitations under the License.""",
    "MIT": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS
        OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
        AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
        OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
        WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE
        SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
        PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
        "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
        CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
        BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
        TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
        THE POSSIBILITY OF SUCH DAMAGE.""",
    "GPL-header": """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details.""",
}

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def rising(seconds: list[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(seconds)
    for i, x in enumerate(seconds):
        k = bisect_left(tops, x)
        back[i] = at[k - 1] if k else -1
        if k == len(tops):
            tops.append(x), at.append(i)
        else:
            tops[k], at[k] = x, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _small(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence of short lists."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of longest common subsequences of a and each beginning of b."""
    row = np.zeros(len(b) + 1, dtype=np.int32)
    for x in a:
        row[1:] = np.maximum(row[1:], row[:-1] + (b == x))
        np.maximum.accumulate(row, out=row)
    return row


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence in linear space: a is halved, b is cut where both halves match most."""
    codes: dict[str, int] = {}
    x, y = (np.array([codes.setdefault(w, len(codes)) for w in words]) for words in (a, b))
    out, parts = [], [(0, len(a), 0, len(b))]
    while parts:
        i, m, j, n = parts.pop()
        if i >= m or j >= n:
            continue
        if (m - i) * (n - j) <= SMALL_GAP or m - i == 1:
            out += [(i + p, j + q) for p, q in _small(a[i:m], b[j:n])]
            continue
        h = (i + m) // 2
        cut = j + int(np.argmax(_row(x[i:h], y[j:n]) + _row(x[h:m][::-1], y[j:n][::-1])[::-1]))
        parts += [(i, h, j, cut), (h, m, cut, n)]
    return sorted(out)


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places (i, j) of words matched in order between a and b.

    What both begin and end with is matched; words that are unique in both are
    anchors, those of a longest rising run of them hold, and the gaps between are
    aligned the same way. A gap without anchors is matched by a longest common
    subsequence, however large.
    """
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        i, m, j, n = gaps.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i >= m or j >= n:
            continue
        once_a = {w for w, k in Counter(a[i:m]).items() if k == 1}
        once = once_a & {w for w, k in Counter(b[j:n]).items() if k == 1}
        if once:
            place = {b[y]: y for y in range(j, n) if b[y] in once}
            pairs = [(x, place[a[x]]) for x in range(i, m) if a[x] in once]
            held = [pairs[k] for k in rising([y for _, y in pairs])]
            for (x0, y0), (x1, y1) in zip([(i - 1, j - 1), *held], [*held, (m, n)]):
                gaps.append((x0 + 1, x1, y0 + 1, y1))
            out += held
        else:
            out += [(i + x, j + y) for x, y in _common(a[i:m], b[j:n])]
    return sorted(out)


class Scanner:
    """Licences in texts."""

    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.templates = [(name, words, Counter(words)) for name, words in ((n, words_of(t)) for n, t in sorted(templates.items())) if words]
        self.vocabulary = {w for _, words, _ in self.templates for w in words}

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(licence, coverage, first word, words) of each place found, in order of licence and place."""
        words = words_of(text)
        there = self.vocabulary.intersection(words)
        out = []
        places: dict[str, list[int]] | None = None
        for name, template, counts in self.templates:
            need = self.coverage * len(template)
            if sum(k for w, k in counts.items() if w in there) < need:
                continue
            if places is None:
                places = {w: [] for w in there}
                for i, w in enumerate(words):
                    if w in places:
                        places[w].append(i)
            out += self._places(name, template, words, places)
        return out

    def _places(self, name: str, template: list[str], words: list[str], places: dict[str, list[int]]) -> list[tuple[str, float, int, int]]:
        n = len(template)
        # a copy lacks less than (1 - coverage) of the template's words, so of one more than that it holds some
        seeds = sorted(range(n), key=lambda q: (len(places.get(template[q], ())), q))[: int((1 - self.coverage) * n + 1e-9) + 1]
        starts = sorted({p - q for q in seeds for p in places.get(template[q], ())})
        slack, stride, found, last = n // 4 + 4, max(1, n // 16), [], None
        for s in starts:
            if last is not None and s - last < stride:
                continue  # within the window before
            last = s
            low, high = max(0, s - slack), min(len(words), s + stride - 1 + n + slack)
            pairs = align(template, words[low:high])
            if len(pairs) >= self.coverage * n - 1e-9:
                first, end = low + pairs[0][1], low + pairs[-1][1] + 1
                found.append((len(pairs) / n, first, end))
        chosen: list[tuple[float, int, int]] = []
        for c, first, end in sorted(found, key=lambda x: (-x[0], x[2] - x[1], x[1])):
            if all(end <= f or first >= e for _, f, e in chosen):
                chosen.append((c, first, end))
        return [(name, c, first, end - first) for c, first, end in sorted(chosen, key=lambda x: x[1])]


FOUND = "doc_id long, license string, coverage double, first_word int, n_words int"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, first_word, n_words): a row for each place of a text that holds a template.

    A template is found where at least `coverage` of its words stand in order, with
    at most a quarter of its length and four words among them; words are runs of
    letters and digits in lower case. Of places that overlap the one with most of
    the template counts. Null and empty texts hold none; each row of docs is scanned
    alone, so repeated rows repeat their finds and there is no shuffle.
    """
    ship(docs.sparkSession)
    scanner = Scanner(TEMPLATES if templates is None else templates, coverage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d.as_py(), *x) for d, t in zip(batch.column(0), batch.column(1)) for x in scanner.scan(t.as_py() or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32()))], names=["doc_id", "license", "coverage", "first_word", "n_words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FOUND)
