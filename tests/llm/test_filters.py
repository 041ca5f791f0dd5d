"""URL filter, quality rules and licence scans on small tables."""

from __future__ import annotations

import random
import re
import textwrap
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import licenses, quality, queries, urls

SPACES = " \t\n\x0b\f\r"


def test_urls_against_rules(spark):
    given = [
        "https://a.b.example.org/es/1?x#y", "http://EXAMPLE.ORG/en/1234", "http://example.org/en/2", "https://badorg/es/", "x://notexample.org/en/1",
        "http://com/fr/", "http://a.com/de/q#/fr/", "http://a.com", "http://a.com?/fr/", "no scheme", "", None, "http://a.net://b.com/de/",
        "http://a.com/de/", "http://a.com/de/", "://com/fr/x\nnext",
    ]
    pages = spark.createDataFrame([(i % 14, u, "clash", "clash") for i, u in enumerate(given)], "page_id long, url string, host string, verdict string")
    rules = urls.rule_table(spark, [*queries.URL_RULES, ("allow", None, "/x"), ("block", "com", "/fr/")][:6])

    def brute(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    for few in (True, False):
        if not few:  # the way taken for rules that are too many to broadcast
            original, urls.fits_broadcast = urls.fits_broadcast, lambda df: False
        found = urls.judge_urls(pages, rules)
        got = sorted(map(repr, map(tuple, found.collect())))
        if not few:
            urls.fits_broadcast = original
        assert got == sorted(repr((i % 14, *brute(u))) for i, u in enumerate(given))
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urls.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def counts_of(text):
    text = text or ""
    words = [w for w in re.split(f"[{SPACES}]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs):
    draw = random.Random(1)
    given = [None, "", " \n\t", "a", "a b c a b c", "x\nx\n\nx \n", "a a a a", "é\xa0b\x85c |<>#", "\x1ca\x0bb", "a b\r\nc a b\n"]
    given += [" ".join(draw.choice("abc\n") for _ in range(draw.randint(0, 40))) for _ in range(60)]
    given += ["word " * 20_000]
    rows = [(i // 2, t) for i, t in enumerate(given)]
    got = quality.judge_quality(docs(rows)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted((r["doc_id"], *[r[n] for n in names]) for r in got) == sorted((i, *counts_of(t)) for i, t in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"]) and r["kept"] is not None
    assert quality.judge_quality(docs([])).count() == 0


def test_quality_keeps_prose_and_drops_outliers(spark, docs):
    draw = random.Random(2)
    say = lambda n: " ".join("".join(draw.choice("aeioustrn") for _ in range(draw.randint(2, 8))) for _ in range(n))
    good = [(i, say(draw.randint(60, 600))) for i in range(300)]
    bad = [(1000 + i, " ".join(w + "###" for w in say(200).split())) for i in range(40)] + [(2000, "x" * 500_000 + " y" + say(60))]
    table = docs(good).unionByName(docs(bad)).unionByName(docs([(3000, say(100))], lang=None, source=None))
    kept = {r["doc_id"] for r in quality.judge_quality(table).filter("kept").collect()}
    assert kept == {i for i, _ in good} | {3000}


def test_mcd_against_numpy(spark):
    """The concentration steps end near the estimate that numpy makes of the clean rows."""
    rng = np.random.default_rng(3)
    clean = rng.normal(size=(2_000, 5)) @ np.diag([3, 2, 1.5, 2, 1]) + [5, 4, 3, 2, 1]
    far = rng.normal(size=(400, 5)) + 40
    rows = [("g", *map(float, v)) for v in np.vstack([clean, far])]
    model = quality.mcd(spark.createDataFrame(rows, "_group string, " + ", ".join(f"_x{i} double" for i in range(5)))).first()
    assert np.allclose([model[f"_m{i}"] for i in range(5)], clean.mean(0), atol=0.3)
    factor = np.array([[model[f"_l{i}{j}"] if j <= i else 0 for j in range(5)] for i in range(5)])
    floor = np.diag(np.square(list(quality.FEATURES.values())))
    ratio = np.diag(factor @ factor.T - floor) / np.diag(np.cov(clean.T))
    assert (ratio > 0.7).all() and (ratio < 1.5).all()


def test_licenses(spark, docs):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    keep = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [
        (0, "Text.\nReleased under the MIT License."), (1, "released UNDER the mit license! Licensed under CC BY-NC 4.0."), (2, mit + "\n" + keep),
        (3, mit + "\nOther words.\n" + keep), (4, None), (5, ""), (6, "... !!"), (7, "Released under the MIT License.\n" * 500), (7, "Licensed under CC BY 4.0."),
        (8, "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ]
    expected = {
        (0, "MIT", 1), (1, "CC-BY-NC-4.0,MIT", 2), (2, "MIT", 1), (3, "MIT", 1), (4, "", 0), (5, "", 0), (6, "", 0), (7, "MIT", 500), (7, "CC-BY-4.0", 1),
        (8, "Apache-2.0", 1),
    }
    for few in (True, False):
        original = licenses.fits_broadcast
        if not few:
            licenses.fits_broadcast = lambda df: False
        found = licenses.scan_licenses(docs(rows), licenses.sentence_table(spark))
        got = {(r["doc_id"], ",".join(r["licenses"]), r["n_matches"]) for r in found.collect()}
        licenses.fits_broadcast = original
        assert got == expected
    spans = licenses.scan_licenses(docs(rows), licenses.sentence_table(spark)).filter("doc_id IN (1, 2)").select("doc_id", F.explode("matches"))
    assert sorted((r["doc_id"], *r["col"]) for r in spans.collect()) == [(1, 0, 0, "MIT"), (1, 1, 1, "CC-BY-NC-4.0"), (2, 0, 1, "MIT")]
    assert licenses.scan_licenses(docs([]), licenses.sentence_table(spark)).count() == 0


def found_licenses(spark, docs, texts):
    found = licenses.scan_licenses(docs(list(enumerate(texts))), licenses.sentence_table(spark)).collect()
    return [",".join(r["licenses"]) for r in sorted(found, key=lambda r: r["doc_id"])]


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
GPL3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published
by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0"""


def wrapped(text, width, mark="", newline="\n"):
    blank = newline + mark.rstrip() + newline
    return blank.join(newline.join(mark + x for x in textwrap.wrap(" ".join(p.split()), width)) for p in text.split("\n\n"))


def test_wrapped_licenses(spark, docs):
    given = [(MIT, "MIT"), (BSD, "BSD"), (GPL3, "GPL-3.0-or-later"), (MPL, "MPL-2.0"), (APACHE, "Apache-2.0")]
    for width, mark, newline in [(10_000, "", "\n"), (80, "", "\n"), (70, " * ", "\n"), (72, "# ", "\r\n"), (33, "// ", "\n"), (60, "dnl ", "\n")]:
        texts = [f"Copyright (c) 2020 Some One{newline}{wrapped(t, width, mark, newline)}{newline}{mark}More words" for t, _ in given]
        assert found_licenses(spark, docs, texts) == [name for _, name in given]
    apart = ["Released under\n\nthe MIT License.", "Released under. The MIT License.", "Copyright 2020 X\nAll rights reserved\nOther words", "All\nrights reserved"]
    assert found_licenses(spark, docs, apart) == ["", "", "proprietary", "proprietary"]


def test_license_texts_and_notices(spark, docs):
    clauses = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
    name = "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    advert = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the University."
    free = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation; {}"
    later = "either version {} of the License, or (at your option) any later version."
    given = [
        (f"All rights reserved.\n\n{BSD}\n\n{clauses}\n\n3. {name.format('the copyright holder')}", "BSD-3-Clause"),
        (f"{BSD}\n\n{clauses}\n\n  * {name.format('Some Company Inc.')}", "BSD-3-Clause"), (f"{BSD}\n\n{clauses}", "BSD-2-Clause"),
        (f"{BSD}\n\n{clauses}\n\n{advert}\n\n4. {name.format('the University')}", "BSD-4-Clause"), (f"{BSD}\n\nOther words.", "BSD"),
        (free.format("program", "General", later.format("2")), "GPL-2.0-or-later"), (free.format("library", "Lesser General", later.format("2.1")), "LGPL-2.1-or-later"),
        (free.format("library", "Library General", later.format("2")), "LGPL-2.0-or-later"), (free.format("program", "Affero General", later.format("3")), "AGPL-3.0-or-later"),
        (free.format("program", "General", "version 2 of the License."), "GPL-2.0"), ("Tool: " + GPL3.replace("This program is", "Tool is"), "GPL-3.0-or-later"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
         "above copyright notice and this permission notice appear in all copies.", "ISC"),
        ("This is free and unencumbered software released into the public domain.", "Unlicense"),
        ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
         "https://www.eclipse.org/legal/epl-2.0/", "EPL-2.0"),
        ("This work is licensed under CC BY 4.0.", "CC-BY-4.0"), ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
        ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT"),
        ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("/* SPDX-License-Identifier: GPL-2.0+ */", "GPL-2.0-or-later"),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note", "GPL-2.0"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1-or-later"),
    ]
    deep = "\n".join(f" *         {line.strip()}" if line else " *" for line in clauses.split("\n"))
    for most in (1_000, 1):  # with few beginnings or many, parts are judged alike
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(licenses, "MAX_BEGINNINGS", most)
            assert found_licenses(spark, docs, [f"{BSD}\n\n{clauses}", f" * {BSD}\n *\n{deep}\n"]) == ["BSD-2-Clause"] * 2
    for width, mark in ((75, ""), (66, "# ")):
        assert found_licenses(spark, docs, [wrapped(t, width, mark) for t, _ in given]) == [name for _, name in given]
