"""License scans: winnowed fingerprints pick candidates, banded alignment judges them.

Texts and templates become words (runs of letters and digits, ASCII lower-cased;
all else separates). Of the hashes of a template's GRAM consecutive words,
winnowing keeps the least of every WINNOW consecutive ones; of a template of
SHORT words or fewer all are kept, as a few changes touch most of its windows.
All of a text's hashes are looked up in an inverted index of these fingerprints,
so a text that has GRAM + WINNOW - 1 words of a template unchanged, or GRAM of a
short one, is a candidate there. A local alignment, confined to a band around the
diagonal, counts the template's words that match in order; all of a template's
candidate places in a text are aligned side by side. Matches of COVERAGE or more
of a template are reported with their span of the text; of overlapping matches
the one with most matched words stays, then higher coverage, then the first name.

Defined cases: null and empty texts match nothing; a text may match at several
places, a row each; repeated rows give repeated rows; a template of fewer words
than GRAM is an error.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.superkmer import Words, _gathered, _mix, shortened, span_hashes

GRAM, WINNOW, SHORT = 3, 3, 24
COVERAGE = 0.8
#: Words that the alignment may drift from its diagonal; the larger of this and a tenth of the template.
BAND = 4

# Notices, and license texts from their first condition to the end of their warranty.
_BSD_TERMS = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. '
_BSD_ENDORSEMENT = '3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. '
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Notices and license texts to look for; pass others to scan() as needed, such as the long texts of the Apache and GNU licenses.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "MIT notice": "Released under the MIT License",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "BSD notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "CC0-1.0 notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": _BSD_TERMS + _BSD_WARRANTY,
    "BSD-3-Clause": _BSD_TERMS + _BSD_ENDORSEMENT + _BSD_WARRANTY,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>',
}

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def hashed(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    words = Words([shortened(t.translate(_FOLD)) for t in texts])
    return words, span_hashes(words.data, words.starts, words.ends)


def _grams(h: np.ndarray) -> np.ndarray:
    n = max(0, len(h) - GRAM + 1)
    gram = np.zeros(n, np.uint64)
    for k in range(GRAM):
        gram = _mix(gram + h[k : n + k])
    return gram


def winnowed(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the fingerprints of a sequence of word hashes."""
    gram = _grams(h)
    if not len(gram):
        return np.zeros(0, np.int64), gram
    width = min(WINNOW, len(gram))
    windows = np.lib.stride_tricks.sliding_window_view(gram, width)
    # The rightmost of equal minima.
    at = np.unique(np.arange(len(windows)) + width - 1 - np.argmin(windows[:, ::-1], axis=1))
    return at, gram[at]


@dataclass
class Index:
    """Fingerprint -> the templates and places that have it."""

    names: list[str]
    words: list[np.ndarray]
    values: np.ndarray
    places: list[list[tuple[int, int]]]


def index(templates: dict[str, str]) -> Index:
    names, words, by = sorted(templates), [], defaultdict(list)
    for t, name in enumerate(names):
        _, h = hashed([templates[name].encode()])
        if len(h) < GRAM:
            raise ValueError(f"template {name!r} has fewer than {GRAM} words")
        words.append(h)
        prints = enumerate(_grams(h)) if len(h) <= SHORT else zip(*winnowed(h), strict=True)
        for at, value in prints:
            by[int(value)].append((t, int(at)))
    values = sorted(by)
    return Index(names, words, np.array(values, np.uint64), [by[v] for v in values])


_SCORE, _MATCHED = np.int64(1 << 42), np.int64(1 << 21)
_NONE = np.int64(-1)


def align(template: np.ndarray, text: np.ndarray, diagonals: np.ndarray, band: int) -> np.ndarray:
    """(score, matched words, first, past-last word of text) of the best local alignment within band of each diagonal, a row each.

    A match scores 2; a word replaced, left out or put in costs 1. Of equal
    scores the one with most matched words counts, then the first to begin, then
    the first to end. A diagonal is the text position that the template's first
    word would have.
    """
    width = 2 * band + 1
    steps = np.arange(width, dtype=np.int64)
    low = diagonals.astype(np.int64)[:, None] - band  # the text position of a row's first cell, less the row's number
    padded = np.concatenate([text, np.zeros(1, text.dtype)])
    # A cell is score, matched words and how far before the end of all it began, in one number; below 0 if there is none.
    span = np.int64(len(template) + width)
    above = np.full((len(diagonals), width + 1), _NONE)
    best, last = np.full(len(diagonals), _NONE), np.zeros(len(diagonals), np.int64)
    for i in range(len(template)):
        j = low + i + steps
        inside = (j >= 0) & (j < len(text))
        same = inside & (padded[np.where(inside, j, len(text))] == template[i])
        begun = span - (i + steps)
        came = np.where(above[:, :-1] >= 0, above[:, :-1], begun)
        cell = np.where(same, came + (2 * _SCORE + _MATCHED), came - _SCORE)
        cell = np.where(inside, np.maximum(cell, above[:, 1:] - _SCORE), _NONE)
        # Words put in: the greatest of the cells to the left, less their distance.
        cell = np.maximum.accumulate(np.where(cell >= _SCORE, cell, _NONE - span * _SCORE) + steps * _SCORE, axis=1) - steps * _SCORE
        cell = np.where(inside & (cell >= _SCORE), cell, _NONE)
        above[:, :-1] = cell
        k = cell.argmax(axis=1)
        top = cell[np.arange(len(cell)), k]
        better = top > best
        best, last = np.where(better, top, best), np.where(better, j[np.arange(len(cell)), k] + 1, last)
    hit = best >= 0
    first = diagonals - band + span - best % _MATCHED
    out = np.stack([best // _SCORE, best // _MATCHED % (_SCORE // _MATCHED), first, last], axis=1)
    return np.where(hit[:, None], out, 0)


#: Cells of a band that are aligned side by side.
_CELLS = 1 << 18


def matches(h: np.ndarray, idx: Index) -> list[tuple[str, float, int, int, int]]:
    """(name, coverage, matched words, first, past-last word) of a text's word hashes, without overlaps."""
    values = _grams(h)
    place = np.searchsorted(idx.values, values).clip(0, len(idx.values) - 1)
    diagonals: dict[int, set[int]] = defaultdict(set)
    for at in np.flatnonzero(idx.values[place] == values).tolist():
        for t, q in idx.places[place[at]]:
            diagonals[t].add(at - q)
    found = []
    for t, ds in diagonals.items():
        template = idx.words[t]
        band = max(BAND, len(template) // 10)
        apart = []
        for d in sorted(ds):
            if not apart or d - apart[-1] > band // 2:  # else within the band of the one before
                apart.append(d)
        at_once = max(1, _CELLS // (2 * band + 1))
        for k in range(0, len(apart), at_once):
            for _, matched, first, last in align(template, h, np.array(apart[k : k + at_once]), band).tolist():
                if matched >= COVERAGE * len(template):
                    found.append((idx.names[t], matched / len(template), matched, first, last))
    taken = np.zeros(len(h), bool)
    kept = []
    for m in sorted(set(found), key=lambda m: (-m[2], -m[1], m[0], m[3], m[4])):
        if not taken[m[3] : m[4]].any():
            taken[m[3] : m[4]] = True
            kept.append(m)
    return sorted(kept, key=lambda m: m[3])


_OUT = "doc_id long, license string, coverage double, matched_words long, start_char long, end_char long"


def _raw_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last byte of each word in the text as it is."""
    apart = np.frombuffer(text.translate(_FOLD), np.uint8) == 32
    edge = np.diff(np.concatenate(([True], apart, [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _scanned(batches: Iterator[pa.RecordBatch], idx: Index) -> Iterator[pa.RecordBatch]:
    for rows in _gathered(batches):
        words, h = hashed([text for _, text in rows])
        edges = np.append(words.first, len(h))
        # Texts with any run of words of a template; each is then winnowed on its own.
        grams = _grams(h)
        place = np.searchsorted(idx.values, grams).clip(0, len(idx.values) - 1)
        near = np.unique(words.owner[np.flatnonzero(idx.values[place] == grams)])
        out = []
        for k in near.tolist():
            doc, text = rows[k]
            found = matches(h[edges[k] : edges[k + 1]], idx)
            begins, ends = _raw_spans(text) if found else ((), ())
            for name, coverage, matched, first, last in found:
                start = len(text[: begins[first]].decode("utf-8", "replace"))
                length = len(text[begins[first] : ends[last - 1]].decode("utf-8", "replace"))
                out.append((doc, name, coverage, matched, start, start + length))
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in _OUT.split(", ")])


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each match of a template in a text; start_char and end_char count code points."""
    idx = index(templates or TEMPLATES)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return narrow.mapInArrow(lambda batches: _scanned(batches, idx), _OUT)
