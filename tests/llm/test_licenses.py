"""License scans: winnowing guarantee, alignment against the plain table, planted and changed templates."""

import random

import pytest

from spendframe.llm import licenses as li
from spendframe.llm.base import table
from spendframe.llm.queries import op9_license_scan


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j + 1], new[j], row[j] + (x == y)))
        row = new
    return row[-1]


def test_winnow_keeps_one_in_every_window():
    rng = random.Random(1)
    for _ in range(100):
        hashes = [rng.randrange(20) for _ in range(rng.randint(0, 30))]
        kept = li.winnow(hashes, 4)
        assert all(any(s <= k < s + 4 for k in kept) for s in range(len(hashes) - 3))
        assert not hashes or kept


def test_alignment_in_a_wide_band_is_the_longest_common_sequence():
    rng = random.Random(2)
    for _ in range(100):
        a = [rng.randrange(5) for _ in range(rng.randint(1, 25))]
        b = [rng.randrange(5) for _ in range(rng.randint(0, 25))]
        matched, first, last = li.align(a, b, 0, 60)
        assert matched == longest_common(a, b)
        assert matched == 0 or longest_common(a, b[first : last + 1]) == matched


@pytest.mark.parametrize(("name", "text"), li.TEMPLATES)
def test_every_template_is_found(name, text):
    scanner = li.Scanner(li.TEMPLATES, 3, 2, 8, 0.8)
    before = "Some prose stands here, naïve and long.\n"
    found = scanner.scan(before + text.upper() + " After that, more.")
    assert any(f[0] == name and f[3] == len(before) and f[4] >= len(before) + len(text) - 1 for f in found)
    words = text.split()
    if len(words) > 20:
        tells = lambda w: any(x in li.KEYS or x.isdecimal() for x in li.words_of(w)[0])
        changed = [w for k, w in enumerate(words) if k % 12 != 5 or tells(w)]
        assert any(f[0] == name and 0.8 <= f[1] < 1 for f in scanner.scan(" ".join(changed)))


def test_table(texts):
    line = li.TEMPLATES[0][1]
    rows = [(1, f"x\n{line}\ny {line}"), (2, None), (3, ""), (None, line), (4, "the license under the version"), (5, "w " * 60_000 + line), (1, line), (6, "GNU")]
    got = sorted((str(r.doc_id), r.license, r.n_matched, r.start) for r in li.scan(texts(rows, license="q", start=1)).collect())
    size = len(line)
    want = [("1", "Apache-2.0", 8, 0), ("1", "Apache-2.0", 8, 2), ("1", "Apache-2.0", 8, 2 + size + 3), ("5", "Apache-2.0", 8, 120_000), ("None", "Apache-2.0", 8, 0)]
    assert got == sorted(want)
    assert li.scan(texts(rows).limit(0)).collect() == []
    assert li.scan(texts(rows), (("none", " - "),)).collect() == []
    with pytest.raises(ValueError):
        li.scan(texts(rows), (("big", "x " * (3 << 20)),))


def test_query_finds_the_planted_lines(spark, sf_dir):
    sf = "/root/testdata/sf0.01"
    lines = [text for _, text in li.TEMPLATES]
    want = {(r.doc_id) for r in table(spark, sf, "documents").collect() if any(x in r.text for x in lines)}
    got = {r.doc_id for r in op9_license_scan(spark, sf).collect()}
    assert want and want <= got and len(got) <= len(want) + 3


@pytest.mark.parametrize(("name", "text"), [t for t in li.TEMPLATES if len(t[1].split()) < 20])
def test_repeats_back_to_back_are_places_of_their_own(name, text):
    scanner = li.Scanner(li.TEMPLATES, 3, 2, 8, 0.8)
    for count in (2, 3, 9, 40):
        for gap in ("\n", " and ", " then comes some more here "):
            found = [f for f in scanner.scan(f"Before.\n{gap.join([text] * count)}\nAfter.") if f[0] == name]
            assert [f[3] for f in found] == [8 + k * len(text + gap) for k in range(count)]
            assert all(f[1] == 1 for f in found)


FOREIGN = {
    "This work is licensed under the GNU Library General Public License, version 3.": None,
    "This work is licensed under the GNU General Public License, version 1.": None,
    "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
    "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0",
    "Licensed under CC BY-NC 3.0.": None,
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "CC-BY-NC-SA-4.0",
    "This work is licensed under a Creative Commons Attribution 3.0 Unported License.": None,
    "Licensed under the Apache License, Version 1.1.": None,
    "Released under the BSD License.": None,
    "All rights are reserved.": None,
}


@pytest.mark.parametrize("text", FOREIGN)
def test_relatives_of_a_license_are_not_taken_for_it(text):
    found = li.Scanner(li.TEMPLATES, 3, 2, 8, 0.8).scan(f"Some prose. {text} More of it.")
    assert [f[0] for f in found] == ([FOREIGN[text]] if FOREIGN[text] else [])


def test_notices_and_whole_texts_name_one_license_each():
    texts = dict(reversed([(name, text) for name, text in li.TEMPLATES if len(text.split()) > 25]))
    scanner = li.Scanner(li.TEMPLATES, 3, 2, 8, 0.8)
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "LGPL-2.1", "AGPL-3.0", "Apache-2.0"} <= set(texts)
    for name, text in texts.items():
        assert [(f[0], f[1]) for f in scanner.scan(f"Copyright 2020 A B\n{text}\nint main")] == [(name, 1.0)]
    old = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    assert scanner.scan(old) == []


def brute_scan(text, templates, coverage):
    """Names of the best covered stretches of at most template length plus 8, by longest common sequences, one after another."""
    words = li.words_of(text)[0]
    found = []
    for name, template in templates:
        own = li.words_of(template)[0]
        keys = {w for w in own if w in li.KEYS or w.isdecimal()} | li.KEYS
        for first in range(len(words)):
            for last in range(first, min(len(words), first + len(own) + 8)):
                part = words[first : last + 1]
                if part[0] not in own or part[-1] not in own or len(part) * coverage > len(own):
                    continue
                matched = longest_common(own, part)
                same = sorted(w for w in part if w in keys) == sorted(w for w in own if w in keys)
                if same and matched >= coverage * max(len(own), len(part)):
                    found.append((-matched, -matched / max(len(own), len(part)), first, last, name))
    kept = []
    for matched, _, first, last, name in sorted(found):
        if all(last < k[0] or k[1] < first for k in kept):
            kept.append((first, last, name, -matched))
    return sorted(kept)


def test_scan_equals_every_stretch_tried():
    rng = random.Random(8)
    templates = [t for t in li.TEMPLATES if len(t[1].split()) < 14]
    scanner = li.Scanner(templates, 3, 2, 8, 0.8)
    for _ in range(25):
        parts = []
        for _ in range(rng.randint(1, 3)):
            line = rng.choice(templates)[1].split()
            if rng.random() < 0.5:
                line.insert(rng.randrange(1, len(line)), rng.choice(["plain", "of"]))
            parts += [*line, *rng.choices(["and", "then", "here"], k=rng.randint(1, 6))]
        text = " ".join(parts)
        want = [(name, matched) for _, _, name, matched in brute_scan(text, templates, 0.8)]
        assert [(f[0], f[2]) for f in scanner.scan(text)] == want, text


def test_a_changed_line_beside_a_whole_one_and_a_stray_hit():
    scanner = li.Scanner(li.TEMPLATES, 3, 2, 8, 0.8)
    line = "Licensed under the Apache License, Version 2.0."
    changed = "Licensed under the Apache License, Release 2.0."
    assert [f[2] for f in scanner.scan(f"{changed} {line} {changed}")] == [7, 8, 7]
    stray = "Licensed under the wide sky, Licensed under the plain Apache License, Version 2.0."
    assert [(f[2], f[3]) for f in scanner.scan(stray)] == [(8, stray.index("Licensed under the plain"))]


def test_many_hits_stay_cheap():
    scanner = li.Scanner(li.TEMPLATES, 3, 2, 8, 0.8)
    assert scanner.scan("the License for the specific copies of the Software " * 3000) == []
    assert len(scanner.scan("Released under the MIT License. " * 1000)) == 1000
