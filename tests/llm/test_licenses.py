"""License scans against exact containment at every place."""

import functools
import random
import re

import numpy as np
import pytest

from airsignal.llm import licenses
from airsignal.llm import queries as Q
from airsignal.llm.common import table
from tests.conftest import SF01
from tests.llm.conftest import EDGES


def words(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def grams(w):
    return [tuple(w[i:i + licenses.SHINGLE]) for i in range(len(w) - licenses.SHINGLE + 1)]


@functools.cache
def listed(templates):
    return [(name, (grams(words(t)), set(grams(words(t))))) for name, t in templates]


def exact(text, templates=licenses.TEMPLATES):
    """License -> best containment of one of its templates in any window of the template's length."""
    g, out = grams(words(text)), {}
    seen = set(g)
    for name, s in listed(tuple(templates.items())):
        if not seen & s[1]:
            continue  # nothing of it anywhere
        s = s[0]
        best = max((len(set(g[i:i + len(s)]) & set(s)) for i in range(max(1, len(g) - len(s) + 1))), default=0) / len(set(s))
        if best >= licenses.CONTAINMENT:
            out[name.split(":")[0]] = max(best, out.get(name.split(":")[0], 0))
    return out


def test_documents_equal_brute_force(spark):
    docs = table(spark, SF01, "documents").select("doc_id", "text").collect()
    want = {(r.doc_id, name) for r in docs for name in exact(r.text)}
    got = Q.op10_licenses(spark, SF01).collect()
    assert {(r.doc_id, r.license) for r in got} == want and len(got) == len(want) and want
    text = {r.doc_id: r.text for r in docs}
    for r in got:
        own = {g for n, t in licenses.TEMPLATES.items() if n.split(":")[0] == r.license for g in grams(words(t))}
        assert own & set(grams(words(text[r.doc_id][r.start:r.end])))


def test_edited_notices(spark):
    """Notices with words changed, in any place of a text: found where containment says so."""
    rnd = random.Random(2)
    filler = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    rows = []
    for k in range(150):
        name = rnd.choice(sorted(licenses.NOTICES))
        w = licenses.TEMPLATES[name].split()
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = "changed"
        rows.append((k, f"{filler(rnd.randint(0, 60))} é {' '.join(w).upper()}\n{filler(rnd.randint(0, 60))}"))
    got = {(r.doc_id, r.license): r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {(k, name) for k, t in rows for name in exact(t)}
    assert want <= set(got) and len(want) > 80
    assert all(r.containment >= licenses.CONTAINMENT for r in got.values())


def test_probability():
    assert licenses.meeting_probability(0.58) > 0.9999 and licenses.meeting_probability(1.0) == 1.0
    rng = np.random.default_rng(0)
    met = 0
    for _ in range(300):  # Jaccard 0.6: 30 of 50 in common
        x = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
        a, b = licenses.signatures(np.stack([x[:40], x[10:]]))
        met += bool((a == b).any())
    assert met >= 298


def test_edges(edges, empty, spark):
    assert licenses.scan(edges).count() == 0 and licenses.scan(empty).count() == 0
    own = licenses.scan(edges, {"plain": EDGES[0][1]}).collect()
    assert sorted(r.doc_id for r in own) == [1, 2, 2] and {(r.containment, r.n_matches, r.start) for r in own} == {(1.0, 1, 0)}
    with pytest.raises(ValueError):
        licenses.build({"short": "four words of text"})


def test_long_text_in_stretches(spark, monkeypatch):
    notice = licenses.TEMPLATES["MIT:text"]
    text = "é filler words here " * 150000 + notice + " and more words" * 60000 + " " + notice
    r = {x.license: x for x in licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}["MIT"]
    assert r.n_matches == 2 and text[r.start:r.end].split()[0] == "Permission" and r.end - r.start <= len(notice)


WORDINGS = {
    "This file is licensed under the MIT License": "MIT", "The code is released under the MIT License (see LICENSE)": "MIT", "made available under the terms of the MIT License": "MIT",
    "All files are distributed under the Apache License 2.0 unless stated": "Apache-2.0", "Licensed under the Apache 2.0 License": "Apache-2.0",
    "this library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software "
    "Foundation; either version 3 of the License, or (at your option) any later version": "LGPL",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy was not distributed with this file, You can obtain one at "
    "https://mozilla.org/MPL/2.0/": "MPL-2.0",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and "
    "this permission notice appear in all copies": "ISC",
    "The dataset is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0", "Text is available under CC BY-SA 4.0 by its authors": "CC-BY-SA-4.0",
    "You may use it under the terms of the GNU GPL version 3": "GPL-3.0", "Use of this source code is governed by a BSD-style license found in the LICENSE file": "BSD",
}
PLAIN = ["The license plate of the car was read by the police.", "We talked about the MIT campus and the Apache helicopter.", "Version 2.0 of the report is out now for everyone to read.",
         "Public works are distributed over the whole of the city.", "He was granted permission to use the copy machine free of charge."]


def test_usual_wordings_that_are_no_templates(spark):
    rows = [(k, f"Some words before. {t} And some words after it.") for k, t in enumerate([*WORDINGS, *PLAIN])]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    for k, want in enumerate(WORDINGS.values()):
        assert want in got.get(k, set()), (rows[k][1], got.get(k))
    assert not any(k in got for k in range(len(WORDINGS), len(rows)))


def test_template_spread_over_a_stretch(spark, monkeypatch):
    """Words of any length between a stretch's edge and a template's end, and stretches that would begin inside of a word."""
    monkeypatch.setattr(licenses, "SLICE_BYTES", 400)
    notice = licenses.TEMPLATES["BSD:text"]
    rows = [(k, "w" * (350 + k) + " " + " ".join(["filler"] * (k % 7)) + " " + notice + " " + "é" * 900) for k in range(60)]
    rows += [(100, " ".join(w + "x" * 500 for w in notice.split()) + " " + notice)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("license = 'BSD'").collect()
    assert sorted(r.doc_id for r in found) == [*range(60), 100] and all(r.containment == 1.0 for r in found)


def test_templates_from_a_table(spark):
    t = spark.createDataFrame([("own", "one two three four five six"), ("own", "zzz"), (None, "x"), ("none", None)], "name string, text string")
    lib = licenses.template_table(t)
    assert lib == {"own": "one two three four five six"}
