"""License scans: winnowed fingerprints of templates pick candidates, banded alignment measures them.

Words are runs of letters and digits in lower case.  Every ``gram`` words of a template are hashed
and winnowed (the lowest hash in each ``window`` neighbours stays), into an inverted index from
hash to template and place.  All grams of a document probe the index, so any shared run of
window + gram - 1 words is found.  An alignment in a band around a hit's diagonal counts the
template's words that occur there in order; from a place found, the search goes on in the words left.

Coverage is matched words over the longer of template and place, so words that stand between count
against a place as missing ones do.  Words that tell relatives apart (``KEYS``, and versions in short
templates) must be the template's own, no more and no fewer.  Of places that share words, the best
covered one names them.

The index travels to every task: templates are limited to ``INDEX_BYTES`` of text, checked, which is
hundreds of licenses.  Documents are never shuffled.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spendframe.llm.base import by_bytes, pick, texts_of

INDEX_BYTES = 4 << 20
WORDS = re.compile(r"[^\W_]+")

#: Parts of the templates below that several licenses share.
_GNU = (
    ("GPL-3.0", "General Public License", "3"),
    ("GPL-2.0", "General Public License", "2"),
    ("LGPL-3.0", "Lesser General Public License", "3"),
    ("LGPL-2.1", "Lesser General Public License", "2.1"),
    ("AGPL-3.0", "Affero General Public License", "3"),
)
_GNU_LINE = "This work is licensed under the GNU {}, version {}."
_GNU_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published "
    "by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_CREATIVE = (
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)

#: Names of licenses and the words they are announced with.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        'the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS '
        "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
        "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE "
        "OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    *((name, _GNU_LINE.format(kind, version)) for name, kind, version in _GNU),
    *((name, _GNU_NOTICE.format(kind, version)) for name, kind, version in _GNU),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_END}"),
    *((f"CC-{short}-4.0", f"Licensed under CC {short} 4.0.") for short, _ in _CREATIVE),
    *((f"CC-{short}-4.0", f"This work is licensed under a Creative Commons {long} 4.0 International License.") for short, long in _CREATIVE),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("All-Rights-Reserved", "All rights reserved."),
)

#: Words that tell relatives of a license apart.  A place must hold just those of its template;
#: of templates with fewer than NUMBERED words also the same numbers, which are versions there.
KEYS = frozenset(
    "affero lesser library mit bsd isc apache mozilla gnu by nc nd sa attribution noncommercial noderivatives noderivs sharealike".split()
)
NUMBERED = 60

def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = list(WORDS.finditer(text))
    return [m.group().lower() for m in found], [m.span() for m in found]


def _mix(gram: tuple[int, ...]) -> int:
    return int.from_bytes(hashlib.blake2b(repr(gram).encode(), digest_size=8).digest(), "little")


def winnow(hashes: list[int], window: int) -> list[int]:
    """Places of the lowest hash (the last of equals) in every ``window`` neighbours."""
    kept = []
    for start in range(max(1, len(hashes) - window + 1)):
        part = hashes[start : start + window]
        if part:
            place = start + len(part) - 1 - part[::-1].index(min(part))
            if not kept or kept[-1] != place:
                kept.append(place)
    return kept


def align(template: list[int], words: list[int], shift: int, band: int) -> tuple[int, int, int]:
    """(matched, first, last): most template words that occur in order in ``words``, word j of the document
    within ``band`` of template word i where j - i is near ``shift``; of equal counts the shortest stretch."""
    best: dict[int, tuple[int, int, int]] = {}
    for i, wanted in enumerate(template):
        now: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + shift - band), min(len(words), i + shift + band + 1)):
            ways = [way for way in (now.get(j - 1), best.get(j)) if way]
            if words[j] == wanted:
                before = best.get(j - 1)
                ways.append((before[0] + 1, before[1], j) if before and before[0] else (1, j, j))
            if ways:
                now[j] = max(ways, key=lambda way: (way[0], way[1], -way[2]))  # what follows adds to the latest start the least
        best = now
    return max(best.values(), key=lambda way: (way[0], way[1] - way[2], -way[1]), default=(0, 0, -1))


class Scanner:
    """Templates, their vocabulary and the inverted index."""

    def __init__(self, templates, gram: int, window: int, band: int, coverage: float):
        self.gram, self.band, self.coverage = gram, band, coverage
        self.names = [name for name, _ in templates]
        texts = [words_of(text)[0] for _, text in templates]
        self.numbers = {word: k + 1 for k, word in enumerate(sorted({w for t in texts for w in t} | KEYS))}
        digits = {n for w, n in self.numbers.items() if w.isdecimal()}
        keys = {self.numbers[w] for w in KEYS}
        self.keys = [keys | digits if len(t) < NUMBERED else keys for t in texts]
        self.templates = [[self.numbers[w] for w in t] for t in texts]
        self.own_keys = [Counter(n for n in t if n in k) for t, k in zip(self.templates, self.keys)]
        self.base = len(self.numbers) + 1
        places: dict[int, list[tuple[int, int]]] = {}
        for number, template in enumerate(self.templates):
            grams = [tuple(template[k : k + gram]) for k in range(max(1, len(template) - gram + 1))]
            for place in winnow([_mix(g) for g in grams], window):
                places.setdefault(self._code(grams[place]), []).append((number, place))
        self.places = places
        self.codes = np.array(sorted(places), np.int64)

    def _code(self, gram) -> int:
        code = 0
        for word in gram:
            code = (code * self.base + word) & (1 << 62) - 1
        return code

    def candidates(self, numbers: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """{template: (place, shift) of its hits, by place}; words outside the templates are 0 and end a gram."""
        shifts: dict[int, list[tuple[int, int]]] = {}
        count = len(numbers) - self.gram + 1
        if count <= 0 or not len(self.codes):
            return shifts
        code, inside = np.zeros(count, np.int64), np.ones(count, bool)
        for k in range(self.gram):
            part = numbers[k : k + count]
            code = (code * self.base + part) & ((1 << 62) - 1)
            inside &= part > 0
        at = np.flatnonzero(inside)
        at = at[np.isin(code[at], self.codes)]
        for place in at.tolist():
            for number, own in self.places[int(code[place])]:
                shifts.setdefault(number, []).append((place, place - own))
        return shifts

    def _align(self, which: int, numbers: np.ndarray, low: int, high: int, shift: int):
        """(matched, first, last) within words ``low`` to ``high``, None below the coverage or with another license's words."""
        template = self.templates[which]
        low, high = max(0, low, shift - self.band), min(high, shift + len(template) + self.band)
        part, least = numbers[low : max(low, high)].tolist(), self.coverage * len(template)
        if (Counter(template) & Counter(part)).total() < least:
            return None
        matched, first, last = align(template, part, shift - low, self.band)
        if matched < max(least, self.coverage * (last - first + 1)):
            return None
        keys = self.keys[which]
        if Counter(n for n in part[first : last + 1] if n in keys) != self.own_keys[which]:
            return None
        return matched, low + first, low + last

    def _places(self, which: int, hits, numbers, low: int, high: int, failed: set[int]) -> Iterator[tuple[int, int, int]]:
        """Places between words ``low`` and ``high`` that share no word.

        From the first hit that is left, the diagonals of the hits within reach are tried, those with most hits
        first.  The search goes on in the words before the place found and from its last word."""
        reach = len(self.templates[which]) + 2 * self.band
        for k, (place, _) in enumerate(hits):
            while place >= low:
                near = list(itertools.takewhile(lambda hit: hit[0] < place + reach, itertools.islice(hits, k, None)))
                for shift, _ in Counter(shift for at, shift in near if at >= low and shift not in failed).most_common():
                    if found := self._align(which, numbers, low, high, shift):
                        break
                    failed.add(shift)
                else:
                    break
                before = [hit for hit in near if low <= hit[0] and hit[0] + self.gram <= found[1]]
                if before:
                    yield from self._places(which, before, numbers, low, found[1], set(failed))
                yield found
                low = found[2] + 1

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, matched words, start, end) of every place that covers enough of a template."""
        words, spans = words_of(text)
        get = self.numbers.get
        numbers = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        found = []
        for number, hits in self.candidates(numbers).items():
            size = len(self.templates[number])
            for matched, first, last in self._places(number, hits, numbers, 0, len(words), set()):
                found.append((self.names[number], matched / max(size, last - first + 1), matched, spans[first][0], spans[last][1]))
        return _best_of(found)


def _best_of(found):
    """Places that share no words: of those that do, the one with most matched words, then the best covered."""
    kept: list[tuple[str, float, int, int, int]] = []
    starts: list[int] = []
    for one in sorted(found, key=lambda f: (-f[2], -f[1], f[3], f[0])):
        at = bisect.bisect_left(starts, one[4])  # kept places are apart, so only the last one that starts before can touch
        if at and kept[at - 1][4] > one[3]:
            continue
        kept.insert(at, one)
        starts.insert(at, one[3])
    return kept


def scan(
    docs: DataFrame,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    *,
    gram: int = 3,
    window: int = 2,
    band: int = 8,
    coverage: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per place: ``doc_id``, ``license``, ``coverage`` (matched words over the longer of template and place),
    ``n_matched`` (template words), ``start``, ``end`` (code points).  Places share no words.

    Null and empty texts hold none; null ids are kept; repeated rows are reported each; templates without
    words are left out; other columns are ignored; an empty table gives no rows."""
    if sum(len(text.encode()) for _, text in templates) > INDEX_BYTES:
        raise ValueError(f"templates of more than {INDEX_BYTES} bytes: scan them in several calls")
    usable = tuple((name, text) for name, text in templates if words_of(text)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(usable, gram, window, band, coverage)
        for batch in by_bytes(batches, 8 << 20):
            rows = [(k, *hit) for k, text in enumerate(texts_of(batch)) for hit in scanner.scan(text)]
            at, *rest = zip(*rows) if rows else [()] * 6
            types = (pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int32())), *(pa.array(c, t) for c, t in zip(rest, types))],
                ["doc_id", "license", "coverage", "n_matched", "start", "end"],
            )

    plain = pick(docs, doc_id=id_col, text=text_col)
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(run, f"doc_id {kind}, license string, coverage double, n_matched int, start int, end int")
