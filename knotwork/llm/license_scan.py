"""License notices in documents: winnowed fingerprints pick candidates, banded alignment confirms them.

Each template's word k-grams are hashed and winnowed (the smallest hash of every window stays), which gives an inverted
index from fingerprint to template and place. A document's k-grams are looked up in it; hits of one template on nearby
diagonals make a candidate region, and banded alignments of template and region give every occurrence's matched words, its
coverage of the template and its span in the document. Any passage that shares ``GRAM + WINDOW - 1`` words in a row with a
template has a hit.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from knotwork.llm.common import digest_input, prepare, slices, table, tidy, utf8_buffers
from knotwork.llm.shingles import U, mix

GRAM, WINDOW, BAND, COVERAGE = 3, 2, 8, 0.8
#: Texts of notices and of short licenses, by identifier.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-2": "Licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-sentence": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "All-rights-reserved": "All rights reserved.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
SCHEMA = "doc_id long, license string, coverage double, matched_words long, template_words long, start_char long, end_char long"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_INNER = np.zeros(256, bool)
_INNER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD1B54A32D192ED03))
_BASE = 0x9E3779B97F4A7C15


def _words(raw: np.ndarray, offs: np.ndarray):
    """Word hashes (runs of letters and digits, A-Z folded), each word's text and its begin and end bytes."""
    n = len(raw)
    inner = _INNER[raw]
    start, end = inner.copy(), inner.copy()
    if n:
        start[1:] &= ~inner[:-1]
        end[:-1] &= ~inner[1:]
        cut = offs[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        start[cut] = inner[cut]
        end[cut - 1] = inner[cut - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    h = np.zeros(len(s), np.uint64)
    size = e - s
    live = np.arange(len(s))
    folded = _VALUE[_FOLD[raw]] if n else np.zeros(0, np.uint64)
    step = 0
    while len(live):  # one character of every word a step
        live = live[size[live] > step]
        if step >= 64 and len(live):  # very long words: the rest at once
            for i in live.tolist():
                x = int(h[i])
                for v in folded[s[i] + step : e[i]].tolist():
                    x = (x * _BASE + v) % 2**64
                h[i] = x
            break
        h[live] = h[live] * U(_BASE) + folded[s[live] + step]
        step += 1
    return mix(h), np.searchsorted(offs, s, "right") - 1, s, e


def _grams(h: np.ndarray) -> np.ndarray:
    k = max(len(h) - GRAM + 1, 0)
    x = np.zeros(k, np.uint64)
    for j in range(GRAM):
        x = x * U(0xD6E8FEB86659FD93) + h[j : j + k]
    return mix(x)


def winnow(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the fingerprints: the last smallest hash of every window."""
    if not len(grams):
        return np.zeros(0, np.int64)
    window = min(window, len(grams))
    view = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(np.arange(len(view)) + window - 1 - np.argmin(view[:, ::-1], 1))


@lru_cache(maxsize=1)
def index():
    """``(fingerprints sorted, template of each, place of each, word hashes by template, names)``."""
    names, prints, owner, place, words = list(TEMPLATES), [], [], [], []
    for t, text in enumerate(TEMPLATES.values()):
        raw = np.frombuffer(text.encode(), np.uint8)
        h = _words(raw, np.array([0, len(raw)]))[0]
        g = _grams(h)
        at = winnow(g)
        words.append(h)
        prints.append(g[at]), owner.append(np.full(len(at), t)), place.append(at)
    prints, owner, place = map(np.concatenate, (prints, owner, place))
    order = np.argsort(prints, kind="stable")
    return prints[order], owner[order], place[order], words, names


def align(template: np.ndarray, region: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Longest common subsequence of words within a band around the diagonal: (matched, first and last matched place in region).

    Of alignments with as many matches the one that begins last is told, then the one that ends first: of a notice that
    stands twice in the region, its words come from one occurrence.
    """
    m, n = len(template), len(region)
    best: dict[int, tuple[int, int, int]] = {}  # region place -> (matched, first, -last), of alignments that end there or before
    done = (0, 0, 1)
    for i in range(m):
        lo, hi = max(0, i + shift - band), min(n, i + shift + band + 1)
        row: dict[int, tuple[int, int, int]] = {}
        left = (0, 0, 1)
        for j in range(lo, hi):
            now = max(left, best.get(j, (0, 0, 1)))
            if template[i] == region[j]:
                d = best.get(j - 1, (0, 0, 1))
                now = max(now, (d[0] + 1, d[1] if d[0] else j, -j))
            row[j] = left = now
            done = max(done, now)
        best = row
    return done[0], done[1], -done[2]


def matches(template: np.ndarray, region: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """All occurrences of a template in a region, best first; each is taken out of the region before the next is sought."""
    found, left = [], region.copy()
    while True:
        matched, x, y = align(template, left, shift)
        if y < 0 or matched < COVERAGE * len(template):
            return found
        found.append((matched, x, y))
        left[x : y + 1] = 0  # no word's hash


def scan_texts(texts: pa.Array) -> list[tuple[int, str, float, int, int, int, int]]:
    prints, owner, place, templates, names = index()
    raw, offs = utf8_buffers(texts)
    h, doc, s, e = _words(raw, offs)
    g = _grams(h)
    whole = doc[: len(g)] == doc[GRAM - 1 : GRAM - 1 + len(g)]
    lo, hi = np.searchsorted(prints, g, "left"), np.searchsorted(prints, g, "right")
    at = np.flatnonzero((hi > lo) & whole)
    if not len(at):
        return []
    lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    hits = sorted({(int(doc[i]), int(owner[k]), int(i - first[doc[i]]), int(place[k])) for i in at.tolist() for k in range(lo[i], hi[i])})
    regions: list[list[int]] = []  # document, template, first and last diagonal
    for d, t, p, q in hits:
        diagonal = p - q
        if regions and regions[-1][:2] == [d, t] and diagonal - regions[-1][2] <= BAND:
            regions[-1][3] = max(regions[-1][3], diagonal)
        else:
            regions.append([d, t, diagonal, diagonal])
    found = []
    for d, t, near, far in sorted({tuple(r) for r in regions}):
        own = h[first[d] : first[d + 1]]
        m = len(templates[t])
        a, b = max(0, near - BAND), min(len(own), far + m + BAND)
        for matched, x, y in matches(templates[t], own[a:b], near - a):
            i, j = first[d] + a + x, first[d] + a + y
            found.append((d, names[t], matched / m, matched, m, int(lead[s[i]] - lead[offs[d]]), int(lead[e[j]] - lead[offs[d]])))
    found = sorted(set(found))  # neighbouring regions may tell the same
    found.sort(key=lambda r: (r[0], -r[3], -r[2], r[5], r[1]))
    kept: list[tuple] = []
    spans: dict[int, list[tuple[int, int]]] = {}
    for r in found:  # of overlapping matches the one with more matched words stays
        own = spans.setdefault(r[0], [])
        k = bisect_left(own, (r[5], r[6]))
        if (k == 0 or own[k - 1][1] <= r[5]) and (k == len(own) or own[k][0] >= r[6]):
            own.insert(k, (r[5], r[6]))
            kept.append(r)
    return sorted(kept, key=lambda r: (r[0], r[5], r[1]))


def _scan(batches):
    for whole in batches:
        for b in slices(whole, "text", 1 << 20):
            rows = scan_texts(b.column(1))
            if rows:
                ids = b.column(0).take(pa.array([r[0] for r in rows]))
                cols = list(zip(*rows, strict=True))
                yield pa.record_batch([ids, pa.array(cols[1]), pa.array(cols[2]), *(pa.array(c, pa.int64()) for c in cols[3:])], names=["doc_id", "license", "coverage", "matched_words", "template_words", "start_char", "end_char"])


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match: ``doc_id, license, coverage, matched_words, template_words, start_char, end_char``.

    A match covers at least ``COVERAGE`` of its template's words; of overlapping matches the one with more matched words
    is reported, then the higher coverage, the earlier, the smaller name. Null and empty texts have no match; null ids
    stay null; repeated rows match each; an empty table gives an empty result; other columns are ignored. Whole texts
    are scanned.
    """
    prepare(df.sparkSession)
    return digest_input(df, id_col, text_col).mapInArrow(tidy(_scan), SCHEMA)


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
