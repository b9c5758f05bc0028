"""License scans by conditional compression.

Candidate blocks are found by runs of a template's words: whatever differs from
a template in no more words than allowed holds a run of its words, so nothing is
lost by that, however the text is wrapped. A block is compressed with zstandard,
plainly and with each template as a raw dictionary; the templates are ranked by
the bytes they save, and winners are confirmed by their exact wording
differences, at every place that their runs give. The bytes only rank: in a
large block a notice can cost bytes and is confirmed all the same.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from ._memory import lean
from ._text import hash_blob, shingle_hashes, taken, word_hash_run, words_and_places

#: Differing words that a template of so many words may have (one in ten, rounded down).
TOLERANCE = 0.1
#: Words that tell licenses apart: none of them may differ, nor a word with a digit.
TELLING = frozenset("mit apache gnu lesser affero bsd isc mozilla creative commons attribution noncommercial sharealike noderivatives nc sa nd by zero cc0 unlicense boost mpl gpl lgpl agpl not without".split())
#: Words of a run that is looked for, where the template's guaranteed run is not shorter.
RUN = 6
#: Words of a block at most; a longer stretch of candidates is several blocks.
BLOCK_WORDS = 1024
LEVEL = 3

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."

#: (license, wording): fixed values, the licenses' own public notices.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", _GNU.format(name="General Public License", version="3")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", _GNU.format(name="General Public License", version="2")),
    ("LGPL-3.0", _GNU.format(name="Lesser General Public License", version="3")),
    ("AGPL-3.0", _GNU.format(name="Affero General Public License", version="3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("All-Rights-Reserved", "All rights reserved."),
)


def words(text: str) -> list[str]:
    """Runs of ASCII letters, digits and non-ASCII characters of the lower-cased text, as in `_text`."""
    blob = text.lower().encode("utf-8", "surrogatepass")
    return [w.decode("utf-8", "surrogatepass") for w in words_and_places(blob)[0]]


@dataclass(frozen=True)
class Finding:
    license: str
    line: int
    plain_bytes: int
    saved_bytes: int
    rank: int
    differences: list[str]
    wording: str


@dataclass(frozen=True)
class Place:
    """A confirmed template: words ``start`` to ``end`` of a text."""

    template: int
    start: int
    end: int
    differences: tuple[str, ...]


def allowed(n: int) -> int:
    """Words missing, or added, that a template of ``n`` words may have at most."""
    return int(n * TOLERANCE)


def guaranteed(n: int) -> int:
    """Words of the longest run that a place with no more differences than allowed must hold."""
    d = allowed(n)
    return -(-(n - d) // (2 * d + 1))


def aligned(want: Sequence[str], found: Sequence[str]) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(edits, start, end, equal pairs) of the cheapest alignment of all of ``want`` with a stretch of ``found``.

    A word missing or added costs 1; of equal costs the latest start, then the
    shortest stretch counts.
    """
    n, m = len(want), len(found)
    codes: dict[str, int] = {}
    a = np.array([codes.setdefault(w, len(codes)) for w in want])
    b = np.array([codes.setdefault(w, len(codes)) for w in found])
    # cost * (m + 1) - start, so that one minimum settles both.
    scale = m + 1
    rows = [-np.arange(m + 1)]
    for i in range(n):
        last = rows[-1]
        row = last + scale
        same = b == a[i]
        row[1:][same] = np.minimum(row[1:][same], last[:-1][same])
        steps = np.arange(m + 1) * scale
        rows.append(np.minimum.accumulate(row - steps) + steps)
    end = int(np.argmin(rows[-1]))
    best = int(rows[-1][end])
    cost = -(-best // scale)
    start = cost * scale - best
    pairs, i, j = [], n, end
    while i:
        if j and a[i - 1] == b[j - 1] and rows[i][j] == rows[i - 1][j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif rows[i][j] == rows[i - 1][j] + scale:
            i -= 1
        else:
            j -= 1
    return cost, start, end, pairs[::-1]


class Scanner:
    """Compressors and word runs of a set of templates; build one for a task and scan many texts."""

    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES):
        self.templates = [(name, words(wording)) for name, wording in templates]
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.given = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, w in self.templates]
        # By length of run: its hash, template and place in it.
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        found: dict[int, list[tuple[int, int, int]]] = {}
        for t, (_, w) in enumerate(self.templates):
            if w:
                size = min(RUN, guaranteed(len(w)), len(w))
                hashes = hash_blob(" ".join(w).encode("utf-8", "surrogatepass"))[0]
                found.setdefault(size, []).extend((int(h), t, k) for k, h in enumerate(shingle_hashes(hashes, size)))
        for size, rows in found.items():
            rows.sort()
            self.runs[size] = (np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))

    def offsets(self, hashes: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(template, word places at which it would begin), by the runs that a text has."""
        out: dict[int, set[int]] = {}
        for size, (keys, template, place) in self.runs.items():
            if len(hashes) < size:
                continue
            text = shingle_hashes(hashes, size)
            at = np.flatnonzero(np.isin(text, keys))
            low, high = np.searchsorted(keys, text[at]), np.searchsorted(keys, text[at], side="right")
            for p, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
                for k in range(a, b):
                    out.setdefault(int(template[k]), set()).add(p - int(place[k]))
        for t in sorted(out):
            yield t, sorted(out[t])

    def confirm(self, template: int, found: Sequence[str], low: int, high: int) -> Place | None:
        """The template's place among words ``low`` to ``high``, None if its wording differs too much."""
        want = self.templates[template][1]
        n = len(want)
        for at in range(low, high - n + 1):
            if found[at] == want[0] and found[at : at + n] == want:
                return Place(template, at, at + n, ())
        _, start, end, pairs = aligned(want, found[low:high])
        if not pairs:
            return None
        kept, held = {i for i, _ in pairs}, {j for _, j in pairs}
        missing = [want[i] for i in range(len(want)) if i not in kept]
        added = [found[low + j] for j in range(start, end) if j not in held]
        if max(len(missing), len(added)) > allowed(len(want)) or any(w in TELLING or any(c.isdigit() for c in w) for w in (*missing, *added)):
            return None
        return Place(template, low + start, low + end, (*(f"-{w}" for w in missing), *(f"+{w}" for w in added)))

    def candidates(self, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """(low, high, template) of the stretches that may hold a template, by their runs.

        Beginnings that allowed differences can have moved apart are one candidate.
        """
        out = []
        for t, starts in self.offsets(hashes):
            n, slack, done = len(self.templates[t][1]), allowed(len(self.templates[t][1])), None
            for s in starts:
                if done is None or s > done:
                    done = s + slack
                    out.append((max(0, s - slack), min(len(hashes), s + n + 3 * slack), t))
        return sorted(out)

    def ranked(self, block: str) -> tuple[int, dict[int, tuple[int, int]]]:
        """The block's plain size and each template's (bytes saved, rank): most first, ties to the longer then the earlier template."""
        raw = block.encode("utf-8", "surrogatepass")
        size = len(self.plain.compress(raw))
        saved = [size - len(c.compress(raw)) for c in self.given]
        order = sorted(range(len(saved)), key=lambda k: (-saved[k], -len(self.templates[k][1]), k))
        return size, {k: (saved[k], rank) for rank, k in enumerate(order, 1)}

    def scan(self, text: str | None) -> list[Finding]:
        """Every license of a whole text, in order. A confirmed place within that of another is not a winner; of places that overlap otherwise the better ranked wins."""
        blob = (text or "").lower().encode("utf-8", "surrogatepass")
        hashes = word_hash_run(blob)
        if not any(len(hashes) >= size and np.isin(shingle_hashes(hashes, size), keys).any() for size, (keys, _, _) in self.runs.items()):
            return []
        raw, starts, ends = words_and_places(blob)
        found = [w.decode("utf-8", "surrogatepass") for w in raw]
        won: dict[Place, tuple[int, int, int]] = {}
        for block in _blocks(self.candidates(hashes)):
            size, rank = self.ranked(" ".join(found[block[0][0] : max(high for _, high, _ in block)]))
            for low, high, t in sorted(block, key=lambda c: (rank[c[2]][1], c[0])):
                place = self.confirm(t, found, low, high)
                if place:
                    won.setdefault(place, (size, *rank[t]))
        lines = np.flatnonzero(np.frombuffer(blob, dtype=np.uint8) == 10)
        out = []
        for p in _winners({p: rank for p, (_, _, rank) in won.items()}):
            low, high = int(starts[p.start]), int(ends[p.end - 1])
            out.append(Finding(self.templates[p.template][0], int(np.searchsorted(lines, low)), *won[p], list(p.differences), blob[low:high].decode("utf-8", "replace")))
        return out


def _blocks(candidates: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Neighbouring candidates, in order, as long as they begin within BLOCK_WORDS words."""
    block: list[tuple[int, int, int]] = []
    for c in candidates:
        if block and c[0] >= block[0][0] + BLOCK_WORDS:
            yield block
            block = []
        block.append(c)
    if block:
        yield block


def _winners(ranks: dict[Place, int]) -> list[Place]:
    """Places in order: none within a longer one; of those that overlap otherwise the better ranked, then the earlier."""
    order = sorted(ranks, key=lambda p: (p.start, -p.end, ranks[p]))
    # Of places in order of their starts, one lies within another if an earlier one ends later.
    whole, reach = [], -1
    for p in order:
        if p.end > reach or (whole and (p.start, p.end) == (whole[-1].start, whole[-1].end)):
            whole.append(p)
        reach = max(reach, p.end)
    taken_: list[tuple[int, int, Place]] = []
    for p in sorted(whole, key=lambda p: (ranks[p], p.start, p.template)):
        at = bisect.bisect_left(taken_, p.start, key=lambda x: x[0])
        if (at == 0 or taken_[at - 1][1] <= p.start) and (at == len(taken_) or p.end <= taken_[at][0]):
            taken_.insert(at, (p.start, p.end, p))
    return [p for _, _, p in taken_]


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """A row for each license found: doc_id, license, line, plain_bytes, saved_bytes, rank, differences, wording.

    ``line`` counts from 0; ``rank`` is the confirmed template's among all by
    bytes saved; ``differences`` lists its missing (-) and added (+) words;
    ``wording`` is the passage in lower case. Whole texts are scanned. Null and
    empty texts and texts without a license have no rows. A null doc_id stays
    null; repeated rows are scanned each; an empty table gives no rows. Other
    columns are not read.
    """
    templates = list(templates)
    schema = "doc_id bigint, license string, line int, plain_bytes int, saved_bytes int, rank int, differences array<string>, wording string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in taken(batches, 1):
            rows = [(doc, f) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f in scanner.scan(text)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([d for d, _ in rows], pa.int64()),
                    "license": pa.array([f.license for _, f in rows], pa.string()),
                    "line": pa.array([f.line for _, f in rows], pa.int32()),
                    "plain_bytes": pa.array([f.plain_bytes for _, f in rows], pa.int32()),
                    "saved_bytes": pa.array([f.saved_bytes for _, f in rows], pa.int32()),
                    "rank": pa.array([f.rank for _, f in rows], pa.int32()),
                    "differences": pa.array([f.differences for _, f in rows], pa.list_(pa.string())),
                    "wording": pa.array([f.wording for _, f in rows], pa.string()),
                }
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(work), schema)
