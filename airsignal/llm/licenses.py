"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Texts and templates are words (runs of ASCII letters, digits and bytes of other characters, lower-cased in ASCII) and shingles
of ``SHINGLE`` words. For each length of template there are windows of that many shingles, an eighth of a window apart.
A window's MinHash signature is cut into bands; a template with an equal band is retrieved. A window
in which the template is held to ``CONTAINMENT`` or more, at most half a step away, has a Jaccard similarity of at least
0.58 with it, and 24 bands of 2 rows then meet with a probability over 0.9999 (``meeting_probability``). Equal windows meet always.
A band can be equal only where a window holds a shingle of a template, so only such windows are signed.
A retrieved template is verified: the share of its distinct shingles found around the window must reach ``CONTAINMENT``.

Results: one row per text and template found, none for a text without one; null, empty and short texts have none. Repeated
rows are reported each. Templates of fewer words than a shingle are refused. Of equal containments the first place counts.
Columns other than doc_id and text are ignored. Texts longer than a stretch are read in stretches that begin with a word and overlap by
as many words as the longest window with its margins has, however long the words are.

``TEMPLATES`` holds the usual licence families: the notices that licensors ask to have written, openings of the licence texts, and the
customary short forms, made of phrases (``short_forms``). A template's name is the licence, with what kind of wording it is after a colon. Other templates can be given, or read
from a table with ``template_table``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airsignal.llm.common import SLICE_BYTES, Powers, mix, range_hashes, row_slices, text_buffer, words_of

SHINGLE, CONTAINMENT = 5, 0.8
#: Bands and rows of a signature.
BANDS, ROWS = 24, 2
#: Short names of licences, as customary lines give them.
NAMES = {
    "MIT": ["the MIT License", "the MIT licence", "an MIT-style license"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache License Version 2.0"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GNU GPL version 2", "the GPL v2 license"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GNU GPL version 3", "the GPL v3 license"],
    "LGPL": ["the GNU Lesser General Public License", "the GNU LGPL version 2.1", "the GNU LGPL version 3"],
    "AGPL-3.0": ["the GNU Affero General Public License", "the GNU AGPL version 3"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "the Mozilla Public License, v. 2.0"],
    "EPL-2.0": ["the Eclipse Public License 2.0", "the Eclipse Public License, version 2.0"],
    "BSD": ["the BSD license", "the 2-clause BSD license", "the 3-clause BSD license", "a BSD-style license"],
    "ISC": ["the ISC license"],
    "CC-BY-4.0": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
}
#: How customary lines lead to the name.
PHRASES = ["Licensed under {}", "Released under {}", "Distributed under {}", "Available under {}", "Published under {}", "is licensed under {}", "is released under {}",
           "is distributed under {}", "are licensed under {}", "licensed under the terms of {}", "under the terms of {}", "subject to the terms of {}", "covered by {}",
           "made available under {}", "provided under {}", "governed by {}"]

#: Notices as licensors ask to have them written, and openings of the licence texts.
NOTICES = {
    "Apache-2.0:notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                         "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT:text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
                "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
                "distribute, sublicense, and/or sell copies of the Software",
    "GPL-3.0:work": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0:notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                      "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0:notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
                      "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL:warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
                    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL:notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
                   "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0:notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
                       "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0:notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
                      "You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0:notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
                      "https://www.eclipse.org/legal/epl-2.0",
    "BSD:text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD:warranty": "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, "
                    "the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
    "BSD:file": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "ISC:text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
                "copyright notice and this permission notice appear in all copies.",
    "Unlicense:text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
                      "distribute this software",
    "CC0-1.0:notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public "
                      "domain worldwide. This software is distributed without any warranty.",
    "CC-BY-4.0:notice": "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit "
                        "http://creativecommons.org/licenses/by/4.0/",
    "CC-BY-SA-4.0:notice": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit "
                           "http://creativecommons.org/licenses/by-sa/4.0/",
    "CC-BY-NC-4.0:notice": "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit "
                           "http://creativecommons.org/licenses/by-nc/4.0/",
    "zlib:text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
                 "from the use of this software.",
    "BSL-1.0:notice": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
}


def short_forms() -> dict[str, str]:
    """Customary lines: every phrase with every name that makes at least a shingle of words."""
    out = {}
    for name, spelled in NAMES.items():
        for i, n in enumerate(spelled):
            for j, phrase in enumerate(PHRASES):
                line = phrase.format(n)
                if len(re.findall(r"[A-Za-z0-9]+", line)) >= SHINGLE:
                    out[f"{name}:line {i + 1}.{j + 1}"] = line
    return out


TEMPLATES = NOTICES | short_forms()


def template_table(table: DataFrame) -> dict[str, str]:
    """Templates from a table (name, text); of several texts of one name the smallest counts. The table is the library, read whole."""
    rows = table.where("name is not null and text is not null").groupBy("name").agg(F.min("text").alias("text")).collect()
    return {r["name"]: r["text"] for r in rows}


def _separators() -> np.ndarray:
    out = np.ones(256, bool)
    out[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
    return out


_SEPARATES = _separators()
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_STEP = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(SHINGLE)], np.uint64)
_SEEDS = np.random.default_rng(42).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def meeting_probability(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Probability that two sets of this Jaccard similarity share a band."""
    return 1 - (1 - similarity ** rows) ** bands


def shingles(data: np.ndarray, offsets: np.ndarray, powers: Powers):
    """Hash, row, first and last byte (exclusive) of each shingle, in order."""
    start, end, row = words_of(data, offsets, _SEPARATES)
    if len(start) < SHINGLE:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    h = range_hashes(_FOLD[data], start, end, powers)
    n = len(h) - SHINGLE + 1
    s = sum(h[k:k + n] * _STEP[k] for k in range(SHINGLE))
    whole = row[:n] == row[SHINGLE - 1:]
    return mix(s)[whole], row[:n][whole], start[:n][whole], end[SHINGLE - 1:][whole]


def signatures(sets: np.ndarray) -> np.ndarray:
    """Band hashes (rows x BANDS) of rows of shingle hashes."""
    out = np.zeros((len(sets), BANDS), np.uint64)
    for k, seed in enumerate(_SEEDS):
        v = sets * seed
        least = (v ^ (v >> np.uint64(32))).min(axis=1)
        out[:, k // ROWS] = out[:, k // ROWS] * np.uint64(0x9E3779B97F4A7C15) + least + np.uint64(k)
    return out


@dataclass
class Index:
    names: list[str]
    sets: list[np.ndarray]  # sorted distinct shingles of each template
    known: np.ndarray  # all of them, sorted
    bits: np.ndarray  # which leading 16 bits occur among them
    lengths: list[tuple[int, np.ndarray, np.ndarray]]  # window length; sorted band keys; their templates

    def has(self, h: np.ndarray) -> np.ndarray:
        out = self.bits[(h >> np.uint64(48)).astype(np.int64)]
        at = np.flatnonzero(out)
        near = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
        out[at] = self.known[near] == h[at]
        return out


def build(templates: dict[str, str]) -> Index:
    names, ordered = sorted(templates), []
    powers = Powers()
    for name in names:
        data = np.frombuffer(templates[name].encode(), np.uint8)
        h = shingles(data, np.array([0, len(data)]), powers)[0]
        if not len(h):
            raise ValueError(f"template {name} has fewer than {SHINGLE} words")
        ordered.append(h)
    sets = [np.unique(h) for h in ordered]
    known = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
    bits = np.zeros(1 << 16, bool)
    bits[(known >> np.uint64(48)).astype(np.int64)] = True
    lengths = []
    for size in sorted({len(h) for h in ordered}):
        own = [k for k, h in enumerate(ordered) if len(h) == size]
        keys = (signatures(np.stack([ordered[k] for k in own])) + np.arange(BANDS, dtype=np.uint64)).reshape(-1)
        owner = np.repeat(own, BANDS)
        order = np.argsort(keys, kind="stable")
        lengths.append((size, keys[order], owner[order]))
    return Index(names, sets, known, bits, lengths)


def _windows(hits: np.ndarray, low: np.ndarray, high: np.ndarray, size: int, step: int) -> np.ndarray:
    """First shingles of the windows that hold a hit: multiples of ``step`` within the row (low to high), and its last window."""
    first = np.maximum(hits - size + 1, low)
    first = low + -(-(first - low) // step) * step
    spread = np.arange(-(-size // step))
    starts = first[:, None] + spread[None, :] * step
    last = np.maximum(high - size, low)  # a row shorter than a window has one, at its start
    starts = np.where((starts <= np.minimum(hits, last)[:, None]), starts, last[:, None])
    return np.unique(starts)


def find(data: np.ndarray, offsets: np.ndarray, index: Index, powers: Powers) -> list[tuple[int, int, float, int, int]]:
    """(row, template, containment, first byte, last byte) of all verified windows."""
    h, row, start, end = shingles(data, offsets, powers)
    if not len(h) or not len(index.known):
        return []
    hits = np.flatnonzero(index.has(h))
    if not len(hits):
        return []
    low, high = np.searchsorted(row, row[hits]), np.searchsorted(row, row[hits], "right")
    out = []
    for size, keys, owner in index.lengths:
        step = max(1, size // 8)
        at = _windows(hits, low, high, size, step)
        r_low, r_high = np.searchsorted(row, row[at]), np.searchsorted(row, row[at], "right")
        for i in range(0, len(at), 4096):
            a, lo, hi = at[i:i + 4096], r_low[i:i + 4096], r_high[i:i + 4096]
            place = np.minimum(a[:, None] + np.arange(size)[None, :], (hi - 1)[:, None])
            bands = signatures(h[place]) + np.arange(BANDS, dtype=np.uint64)
            left, right = np.searchsorted(keys, bands), np.searchsorted(keys, bands, "right")
            w, b = np.nonzero(right > left)
            seen = sorted({(int(x), int(t)) for x, y in zip(w, b, strict=True) for t in owner[left[x, y]:right[x, y]]})
            for x, t in seen:
                p, q = max(int(a[x]) - step, int(lo[x])), min(int(a[x]) + size + step, int(hi[x]))
                inside = np.flatnonzero(np.isin(h[p:q], index.sets[t]))
                share = len(np.unique(h[p:q][inside])) / len(index.sets[t])
                if share >= CONTAINMENT:
                    out.append((int(row[a[x]]), t, share, int(start[p + inside[0]]), int(end[p + inside[-1]])))
    return out


RESULT = "doc_id long, license string, containment double, n_matches long, start long, end long"


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, containment (best), n_matches (places that do not overlap), start and end (code points, exclusive) of the best.

    A license is a template's name up to a colon: all wordings of one are reported together.
    """
    index = build(TEMPLATES if templates is None else templates)
    held = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the templates

    def points(data: np.ndarray, a: int, b: int) -> int:
        return int(np.count_nonzero((data[a:b] & 0xC0) != 0x80))

    need = max((size + 2 * max(1, size // 8) + SHINGLE for size, _, _ in index.lengths), default=SHINGLE)

    def stretches(data, offsets):
        """(bytes, offsets, first row, shift of the first byte in its row); stretches of a long row begin with a word and share ``need`` words."""
        for i, j in row_slices(offsets, SLICE_BYTES):
            a, b = offsets[i], offsets[j]
            if b - a <= 2 * SLICE_BYTES:
                yield data[a:b], offsets[i:j + 1] - a, i, 0
                continue
            at = a  # one long row
            while True:
                length = SLICE_BYTES
                while True:
                    stop = min(b, at + length)
                    starts = words_of(data[at:stop], np.array([0, stop - at]), _SEPARATES)[0]
                    if stop == b or len(starts) > 2 * need + 2:
                        break
                    length *= 2  # words so long that hardly any fit
                if stop < b:
                    stop = at + int(starts[-1])  # the last word may be cut: it is the next stretch's
                yield data[at:stop], np.array([0, stop - at]), i, at - a
                if stop == b:
                    break
                at = at + int(starts[-1 - need])

    def run(batches):
        index, powers = held.value, Powers()
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            found: dict[tuple[int, int], list] = {}
            for piece, off, first, shift in stretches(data, offsets):
                for r, t, share, a, b in find(piece, off, index, powers):
                    origin = shift - int(off[r])  # to bytes within the row
                    found.setdefault((first + r, index.names[t].split(":")[0]), []).append((a + origin, b + origin, share))
            rows = []
            for (r, t), spans in sorted(found.items()):
                spans.sort()
                count, reach = 0, -1
                for a, b, _ in spans:
                    if a >= reach:
                        count += 1
                    reach = max(reach, b)
                a, b, share = min(spans, key=lambda s: (-s[2], s[0], s[1]))
                base = int(offsets[r])
                p = points(data, base, base + a)
                rows.append((batch.column("doc_id")[r].as_py(), t, share, count, p, p + points(data, base + a, base + b)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                                                 names=["doc_id", "license", "containment", "n_matches", "start", "end"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT))
