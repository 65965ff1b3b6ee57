"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Words are runs of letters and digits (every byte above 127 counts as a letter), A-Z in lower case.  Each
three words in a row have a hash; of each window of such hashes the smallest is a fingerprint, so two
texts that share a run of window + 2 words share a fingerprint.  Templates of a few words are found by
all of their word pairs instead.  The templates' fingerprints form an inverted index.  A hit puts a
template on a diagonal of the document.  Template and document are aligned in a band around the diagonal,
and the longest common subsequence gives the matched words.  Where that is too little, the band is widened
by the next hits' diagonals, up to a template's length, so that parts with an insertion between them add up.
A hit inside an accepted match of its template is settled; all others are tried.

The index is as large as the templates, which are constants, so it goes to every task; documents are
scanned whole where they are, without a shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow_text import runs, text_bytes
from tessera.llm.near_dedup import mix, words_between

K = 3
WINDOW = 3
#: Templates of up to so many words are found by word pairs.
SHORT = 8
#: Words that the alignment may leave its diagonal, and least share of a template's words that match.
BAND = 8
COVERAGE = 0.8

# Common notices and the wording of public licences.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "mit-notice": "Released under the MIT License.",
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution."
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}

_PARTS = np.ones(256, bool)
_PARTS[48:58] = _PARTS[65:91] = _PARTS[97:123] = _PARTS[128:] = False


def fingerprints(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word number): of each window of three-word hashes within a text, the smallest, the last of equal ones.

    A text with fewer hashes than a window has has all of them.
    """
    n = len(h) - K + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gram = mix(sum((h[i : n + i] * mix(np.uint64([i + 1])) for i in range(K)), np.zeros(n, np.uint64)))
    whole = text[:n] == text[K - 1 :]
    at, gram, owner = np.flatnonzero(whole), gram[whole], text[:n][whole]
    size = np.bincount(owner, minlength=1)
    chosen = size[owner] < WINDOW
    m = len(gram) - WINDOW + 1
    if m > 0:
        inside = owner[:m] == owner[WINDOW - 1 :]
        best, where = gram[:m].copy(), np.arange(m)
        for i in range(1, WINDOW):
            other = gram[i : m + i]
            lower = other <= best
            best, where = np.where(lower, other, best), np.where(lower, np.arange(m) + i, where)
        chosen[where[inside]] = True
    return gram[chosen], at[chosen]


def pair_hashes(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word number) of all two words in a row within a text."""
    if len(h) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(text[:-1] == text[1:])
    return mix(h[at] * mix(np.uint64([11])) + h[at + 1] * mix(np.uint64([12]))), at


def align(template: np.ndarray, region: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence with low <= region place - template place <= high."""
    wide = high - low + 1
    best = np.zeros((len(template) + 1, wide + 2), np.int32)  # cell c of row i: region prefix i + low + c - 1
    for i in range(1, len(template) + 1):
        j = i + low + np.arange(wide)
        inside = (j >= 1) & (j <= len(region))
        hit = np.zeros(wide, np.int32)
        hit[inside] = region[j[inside] - 1] == template[i - 1]
        # A step along the region costs nothing, so a row is a running maximum.
        best[i, 1:-1] = np.maximum.accumulate(np.maximum(best[i - 1, 1:-1] + hit, best[i - 1, 2:]))
    i, c, out = len(template), int(best[len(template), 1:-1].argmax()) + 1, []
    while i > 0 and c > 0 and best[i, c] > 0:
        if best[i, c] == best[i, c - 1]:
            c -= 1
        elif best[i, c] == best[i - 1, c + 1]:
            i, c = i - 1, c + 1
        else:
            if best[i, c] > best[i - 1, c]:  # at the band's end, a row may also keep what the one before it had
                out.append((i - 1, i + low + c - 2))
            i -= 1
    return out[::-1]


@dataclass
class Scanner:
    """Templates by name, their words, and two indexes from hashes to (template, word number): of fingerprints and of pairs."""

    names: list[str]
    words: list[np.ndarray]
    indexes: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def of(templates: dict[str, str]) -> Scanner:
        names = sorted(templates)
        raw = [templates[n].encode() for n in names]
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
        h, text, _, _ = words_between(np.frombuffer(b"".join(raw), np.uint8), offsets, _PARTS)
        size, start = np.bincount(text, minlength=len(names)), np.searchsorted(text, np.arange(len(names)))
        indexes = []
        for hashes, short in ((fingerprints, False), (pair_hashes, True)):
            key, at = hashes(h, text)
            own = (size[text[at]] <= SHORT) == short
            key, at = key[own], at[own]
            order = np.argsort(key, kind="stable")
            keys, first = np.unique(key[order], return_index=True)
            template = text[at[order]]
            indexes.append((keys, np.append(first, len(key)), template, at[order] - start[template]))
        return Scanner(names, [h[text == i] for i in range(len(names))], indexes)

    def hits(self, h: np.ndarray, text: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """By (text, template): (word, diagonal) of all hits, in order; words are numbered over all texts."""
        out = defaultdict(set)
        for (keys, first, template, place), hashes in zip(self.indexes, (fingerprints, pair_hashes), strict=True):
            key, at = hashes(h, text)
            if not len(key) or not len(keys):
                continue
            k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[k] == key
            for i, w in zip(k[hit].tolist(), at[hit].tolist(), strict=True):
                for e in range(first[i], first[i + 1]):
                    out[int(text[w]), int(template[e])].add((w, w - int(place[e])))
        return {k: sorted(v) for k, v in out.items()}

    def matches(self, h: np.ndarray, lo: int, hi: int, template: np.ndarray, hits: list[tuple[int, int]], coverage: float) -> list[tuple[int, int, int]]:
        """(first word, last word, matched) of a template in the words from lo to hi."""
        found: list[tuple[int, int, int]] = []
        need, size, tried = coverage * len(template), len(template), set()
        for n, (w, d) in enumerate(hits):
            if d in tried or any(a <= w <= b for a, b, _ in found):
                continue
            # Diagonals of later hits that an insertion of up to a template's length explains.
            near = takewhile(lambda hit: hit[0] < d + 2 * size, islice(hits, n + 1, None))  # noqa: B023
            further = sorted({e for _, e in near if d + BAND < e <= d + size})
            before = max([lo, *(b + 1 for _, b, _ in found if b < w)])
            for top in [d, *further]:
                begin, end = max(before, d - BAND), min(hi, top + size + BAND + 1)
                pairs = align(template, h[begin:end], d - BAND - begin, top + BAND - begin)
                if len(pairs) >= need:
                    # The narrowest band that gives as much keeps to this occurrence.
                    tight = (align(template, h[begin:end], d - band - begin, top + band - begin) for band in (0, 1, 2, 4))
                    pairs = next((p for p in tight if len(p) == len(pairs)), pairs)
                    found.append((begin + pairs[0][1], begin + pairs[-1][1], len(pairs)))
                    break
            else:
                tried.add(d)
        return found

    def scan(self, h: np.ndarray, text: np.ndarray, coverage: float = COVERAGE) -> list[tuple[int, int, int, int, int]]:
        """(text, template, first word, last word, matched) for all matches; words are numbered over all texts."""
        found = []
        for (t, m), hits in self.hits(h, text).items():
            lo, hi = (int(np.searchsorted(text, t, side)) for side in ("left", "right"))
            found += [(t, m, *f) for f in self.matches(h, lo, hi, self.words[m], hits, coverage)]
        # Of matches that overlap, the one with the most matched words stays.
        kept: list[tuple[int, int, int, int, int]] = []
        last: dict[int, list] = defaultdict(list)
        for f in sorted(found, key=lambda f: (-f[4], f[0], f[2], f[1])):
            if all(f[3] < a or f[2] > b for a, b in last[f[0]]):
                last[f[0]].append((f[2], f[3]))
                kept.append(f)
        return sorted(kept, key=lambda f: (f[0], f[2]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row per match: doc_id, license, start, end, matched_words, template_words, coverage.

    start and end are code points of the text, end excluded.  Documents without a match, with a null
    or empty text, and empty tables give no rows; repeated rows give their matches each; other columns
    are ignored.
    """
    scanner = Scanner.of(templates or TEMPLATES)
    rows = docs.select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            out: list[tuple] = []
            for i, j in runs(offsets, 4 << 20):
                h, text, start, end = words_between(data, offsets[i : j + 1], _PARTS)
                for t, m, a, b, n in scanner.scan(h, text, coverage):
                    points = [int(np.count_nonzero((data[offsets[i + t] : p] & 0xC0) != 0x80)) for p in (start[a], end[b])]
                    size = len(scanner.words[m])
                    out.append((i + t, scanner.names[m], *points, n, size, n / size))
            ids = batch.column(0).take(pa.array([o[0] for o in out], pa.int64()))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
            columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds, 1)]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "license", "start", "end", "matched_words", "template_words", "coverage"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.filter(F.col("text").isNotNull()).mapInArrow(work, f"doc_id {kind}, license string, start long, end long, matched_words int, template_words int, coverage double")
