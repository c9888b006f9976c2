"""License scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Text is lower-cased and reduced to runs of letters and digits. A template is compared with three kinds of parts of a
document: lines, paragraphs (runs of lines that are not blank) of several lines, and the whole text if it has several
paragraphs. A part names the licence of the template it is most like, or all of them if several are equally like. The
coefficient is 2 |A and B| / (|A| + |B|) over the sets of bigrams, so a part of ``a`` bigrams can only reach
``percent`` with templates of ``a * p / (200 - p)`` to ``a * (200 - p) / p`` of them: other templates are not looked at, nor
are parts that hold too few of a template's bigrams. What is left is compared on the words themselves.

Known are short notices, the file headers of Apache, GNU and Mozilla licences, and the whole texts of MIT, BSD, ISC and zlib. Other
whole texts can be passed as ``templates``.

Cases: null and empty texts, and parts without words, match nothing; a part of one word is one bigram, the word.
Repeated rows are reported each; rows without id are reported with a null id; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sievra.llm.links import PIECE_BYTES
from sievra.llm.words import NOT_ALPHANUMERIC, pieces_of, shingle_hashes, text_buffers, word_hashes

# Fixed texts: notices by which works name their licence, and opening paragraphs of the licences themselves.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "This software is released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, "
            "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
            "Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                   "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                         "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                     "following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)

# Fixed texts: whole licences, and the headers that licences ask to be put in files. Blank lines part paragraphs.
_MIT_REST = """

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE_REST = """

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission."""
_BSD_END = """

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_REST = """

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute
it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""


def _first(name: str, start: str) -> str:
    return next(text for n, text in TEMPLATES if n == name and text.startswith(start))


def _gnu_header(kind: str, version: str, work: str, mark: str) -> tuple[str, str]:
    """The first paragraph of the header of a GNU licence, and the whole header."""
    start = (
        f"This {work} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind} as published by "
        f"the Free Software Foundation{',' if mark == ':' else ';'} either version {version} of the License, or (at your option) any later version."
    )
    rest = (
        f"This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details.\n\n"
        f"You should have received a copy of the GNU {kind} along with this {work}. If not, see <https://www.gnu.org/licenses/>."
    )
    return start, f"{start}\n\n{rest}"


_GNU = (
    ("GPL-2.0-or-later", "General Public License", "2", "program", ";"),
    ("GPL-3.0-or-later", "General Public License", "3", "program", ":"),
    ("LGPL-2.1-or-later", "Lesser General Public License", "2.1", "library", ";"),
    ("LGPL-3.0-or-later", "Lesser General Public License", "3", "program", ":"),
    ("AGPL-3.0-or-later", "Affero General Public License", "3", "program", ":"),
)
TEMPLATES += (
    ("MIT", _first("MIT", "Permission") + _MIT_REST),
    ("Apache-2.0", _first("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the") + _APACHE_REST),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + _BSD_NAMES + _BSD_END),
    ("ISC", _first("ISC", "Permission") + _ISC_REST),
    ("Zlib", _ZLIB),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "version 2 as published by the Free Software Foundation."),
    *((name, text) for name, *form in _GNU for text in _gnu_header(*form) if (name, text) not in TEMPLATES),
)

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BITS = 20


def bigrams(text: bytes) -> set[tuple[bytes, ...]]:
    """The distinct pairs of neighbouring words of a lower-cased text, or its only word."""
    words = _WORD.findall(text)
    return set(zip(words, words[1:])) if len(words) > 1 else {tuple(words)} if words else set()


class Templates:
    """Templates with the hashes of their bigrams."""

    def __init__(self, templates: tuple[tuple[str, str], ...], percent: int):
        self.percent = percent
        self.names = [name for name, _ in templates]
        self.sets = [bigrams(text.lower().encode()) for _, text in templates]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        raw, offsets = text_buffers(pa.array([t.lower() for _, t in templates], pa.large_string()))
        hashes, places = shingle_hashes(*word_hashes(raw, offsets, NOT_ALPHANUMERIC), 2)
        self.hashes = [np.unique(hashes[a:b]) for a, b in zip(places[:-1], places[1:])]
        self.every = np.unique(np.concatenate(self.hashes)) if self.hashes else np.zeros(0, np.uint64)
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self.every >> np.uint64(64 - _BITS)] = True
        self.has = np.array([np.isin(self.every, h) for h in self.hashes]).reshape(len(self.hashes), len(self.every))

    def candidates(self, words: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
        """``(part, template)`` pairs that sizes and shared bigrams allow."""
        hashes, places = shingle_hashes(words, starts, 2)
        if not len(self.every) or not len(hashes):
            return []
        at = np.flatnonzero(self.bits[hashes >> np.uint64(64 - _BITS)])
        rank = np.minimum(np.searchsorted(self.every, hashes[at]), len(self.every) - 1)
        real = self.every[rank] == hashes[at]
        once = np.unique((np.searchsorted(places, at[real], "right") - 1) * len(self.every) + rank[real])
        part, rank = once // len(self.every), once % len(self.every)
        # The number of different bigrams of a part: at most those it has, and a part repeats some.
        parts, back = np.unique(part, return_inverse=True)
        size = np.array([len(np.unique(hashes[places[p] : places[p + 1]])) for p in parts.tolist()], np.int64)
        out = []
        for t, b in enumerate(self.sizes):
            p = self.percent
            fits = (size * (200 - p) >= p * b) & (p * size <= (200 - p) * b)
            if not fits.any():
                continue
            shared = np.bincount(back, self.has[t][rank], len(parts))
            out += [(int(parts[i]), t) for i in np.flatnonzero(fits & (200 * shared >= p * (size + b)))]
        return out

    def dice(self, part: bytes, template: int) -> float | None:
        """The coefficient of a lower-cased part, None if it is too small."""
        own, other = bigrams(part), self.sets[template]
        shared = len(own & other)
        return 2 * shared / (len(own) + len(other)) if 200 * shared >= self.percent * (len(own) + len(other)) else None


def part_bounds(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(begin, end, row)`` of all lines, of paragraphs of several lines, and of texts of several paragraphs."""
    feeds = np.flatnonzero(raw == 10)
    begin = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
    begin = begin[begin < len(raw)]
    row = np.searchsorted(offsets, begin, "right") - 1
    end = np.minimum(np.append(begin[1:], len(raw)), offsets[row + 1])
    ink = np.concatenate([[0], np.cumsum(~np.isin(raw, (32, 9, 10, 11, 12, 13)))])
    full = ink[end] > ink[begin]
    lines = (begin[full], end[full], row[full])
    # A paragraph goes on while lines with ink follow each other in one text.
    at = np.flatnonzero(full)
    if not len(at):
        return [lines]
    new = np.append(True, (np.diff(at) > 1) | (np.diff(row[at]) > 0))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    several = last > first
    paragraphs = (begin[at[first]][several], end[at[last]][several], row[at[first]][several])
    rows, n = np.unique(row[at[first]], return_counts=True)
    rows = rows[n > 1]
    return [lines, paragraphs, (offsets[rows], offsets[rows + 1], rows)]


def scan(
    docs: DataFrame, templates: tuple = TEMPLATES, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id_col, license, n_parts, dice)``: the licences named in each document, by how many parts, and their best coefficient.

    Templates go to all tasks; documents stay where they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Templates(tuple(templates), percent))

    def run(batches):
        known = shared.value
        for batch in batches:
            found = {"id": [], "license": [], "n_parts": [], "dice": []}
            for a, b in pieces_of(text_buffers(batch.column(1))[1], PIECE_BYTES):
                raw, offsets = text_buffers(batch.column(1).slice(a, b - a))
                words, _ = word_hashes(raw, offsets, NOT_ALPHANUMERIC)
                places = _word_places(raw, offsets)
                best: dict[tuple[int, str], list] = {}
                for begin, end, row in part_bounds(raw, offsets):
                    # Parts may leave gaps and are in order: each takes the words between its bounds.
                    low, high = np.searchsorted(places, begin), np.searchsorted(places, end)
                    some, bounds = _taken(words, low, high)
                    hits: dict[tuple[int, str], float] = {}
                    for part, t in known.candidates(some, bounds):
                        dice = known.dice(raw[begin[part] : end[part]].tobytes(), t)
                        if dice is not None:
                            key = (part, known.names[t])
                            hits[key] = max(dice, hits.get(key, 0.0))
                    most: dict[int, float] = {}
                    for (part, _), dice in hits.items():
                        most[part] = max(dice, most.get(part, 0.0))
                    for (part, name), dice in hits.items():
                        if dice < most[part]:
                            continue
                        entry = best.setdefault((int(row[part]), name), [0, 0.0])
                        entry[0] += 1
                        entry[1] = max(entry[1], dice)
                for (row, name), (n, dice) in sorted(best.items()):
                    for column, value in zip(found.values(), (batch.column(0)[a + row].as_py(), name, n, dice)):
                        column.append(value)
            types = (pa.int64(), pa.string(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found.values(), types)], list(found))

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.lower(text_col).alias("text"))
    return rows.mapInArrow(run, "id BIGINT, license STRING, n_parts BIGINT, dice DOUBLE").withColumnRenamed("id", id_col)


def _word_places(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words begin, as :func:`word_hashes` finds them."""
    inside = ~NOT_ALPHANUMERIC[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    first[edges] = inside[edges]
    return np.flatnonzero(first)


def _taken(words: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of every part one after the other, and where each part begins."""
    n = high - low
    bounds = np.concatenate([[0], np.cumsum(n)])
    return words[np.repeat(low - bounds[:-1], n) + np.arange(bounds[-1])], bounds
