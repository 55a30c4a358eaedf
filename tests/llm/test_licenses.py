"""Licence scan: cosines against plain Python, and inheritance."""

import math
import re
from collections import Counter

from tidewake.llm import licenses as li
from tidewake.llm import license_templates as lt


def plain(rows, threshold):
    texts = [(t or "").lower() for _, _, t in rows]
    lines = [re.findall(li.WORD, x) for t in texts for x in t.split("\n")]
    templates = {k: Counter(re.findall(li.WORD, v.lower())) for k, v in li.TEMPLATES.items()}
    vocabulary = {w for c in templates.values() for w in c}
    df = Counter(w for x in lines for w in set(x) if w in vocabulary)

    def weight(w):
        return math.log((1 + len(lines)) / (1 + (df[w] if w in vocabulary else 0))) + 1

    def norm(c):
        return math.sqrt(sum((n * weight(w)) ** 2 for w, n in c.items()))
    own = {}
    for key, path, text in rows:
        for x in (text or "").lower().split("\n"):
            c = Counter(re.findall(li.WORD, x))
            for name, t in templates.items():
                score = round(sum(c[w] * n * weight(w) ** 2 for w, n in t.items()) / (norm(c) * norm(t) or 1), 9)
                if score >= threshold:
                    own[key, path] = min(own.get((key, path), (1, "")), (-score, name))
    dirs = {}
    for (key, path), best in own.items():
        if path and re.search(li.LICENSE_FILE, path):
            d = re.sub("/?[^/]*$", "", path)
            dirs[d] = min(dirs.get(d, (1, "")), best)
    out = {}
    for key, path, _ in rows:
        if (key, path) in own:
            s, name = own[key, path]
            out[key, path] = (name, -s, None)
            continue
        out[key, path] = (None, None, None)
        d = re.sub("/?[^/]*$", "", path) if path else None
        while d is not None:
            if d in dirs:
                out[key, path] = (dirs[d][1], -dirs[d][0], d)
                break
            d = re.sub("/?[^/]*$", "", d) if d else None
    return out


MIT, APACHE = li.TEMPLATES["MIT"], li.TEMPLATES["Apache-2.0"]
ROWS = [
    (1, "a/LICENSE", MIT + ".\nPermission is hereby granted"), (2, "a/b/x.py", "code of the ship"), (3, "a/b/c/LICENSE.txt", "# " + APACHE), (4, "a/b/c/d/y.py", ""),
    (5, "a/b/own.py", "// " + li.TEMPLATES["GPL-3.0"] + "\nport of call"), (6, "z.py", "no licence"), (7, None, APACHE), (8, None, None), (9, "a", "the under license"),
    (10, "q/COPYING", MIT), (11, "q/COPYING", APACHE), (12, "q/r", "x" * 100_000 + " the"), (2, "a/b/x.py", "code of the ship"), (None, "a/n.py", "words"),
    (13, "ab/x", "not under a"), (14, "w/" + "v/" * 30 + "x", "the the the " * 3000), (15, "m/x", APACHE + "\n" + MIT)]


def test_same_as_plain(spark):
    df = spark.createDataFrame([(*r, 1.0) for r in ROWS], "doc_id long, path string, text string, SCORE double")
    out = li.scan(df)
    got = {(r.doc_id, r.path): (r.license, r.score, r.inherited_from) for r in out.collect()}
    want = plain(ROWS, li.THRESHOLD)
    assert set(got) == set(want)
    for key, (name, score, where) in want.items():
        assert got[key][0] == name and got[key][2] == where, key
        assert score is None or abs(got[key][1] - score) < 1e-8
    assert got[2, "a/b/x.py"][0] == "MIT" and got[4, "a/b/c/d/y.py"][0] == "Apache-2.0" and got[13, "ab/x"][0] is None
    assert li.scan(df.limit(0)).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


GPL = """/*
 * Copyright (C) 2020 A. Body
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU {} Public License as published by
 * the Free Software Foundation, either version {} of the License, or
 * (at your option) any later version.
 */
ship = port"""


def full(name):
    with open(f"{lt._FOLDER}/{name}.txt", encoding="utf-8") as file:
        return file.read()


#: Text and licence.
WHOLE = [
    (GPL.format("General", 3), "GPL-3.0"), (GPL.format("General", 2), "GPL-2.0"), (GPL.format("Affero General", 3), "AGPL-3.0"),
    (GPL.format("Lesser General", "2.1"), "LGPL-2.1"), ("# SPDX-License-Identifier: MIT\nimport os", "MIT"), ("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
    ("SPDX-License-Identifier: Unheard-1.7", None), ("a mit of the port", None), ("Apache ships sail under the moon", None),
    (" ".join(f"word{i}" for i in range(60)) + " Released under the MIT License. " + " ".join(f"more{i}" for i in range(60)), "MIT"),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
    ("Licensed under CC BY-NC-ND 3.0", "CC-BY-NC-ND-3.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("   Apache License\n Version 2.0, January 2004\n http://www.apache.org/licenses/\n", "Apache-2.0"),
    ("/* " + full("MIT").replace("\n", "\n * ") + "*/\n" + "code " * 900, "MIT"), ("Copyright 2001 Somebody\n" + full("BSD-2-Clause"), "BSD-2-Clause"),
    (full("GPL-3.0").replace("\n", " "), "GPL-3.0"), (full("Apache-2.0")[2000:], "Apache-2.0")] + [(full(name), name) for name in lt._FULL]


def test_headers_files_and_windows(spark):
    rows = [(k, f"d{k}/LICENSE", text) for k, (text, _) in enumerate(WHOLE)] + [(1000 + k, f"d{k}/x.c", "port") for k in range(len(WHOLE))]
    rows += [(5000 + k, None, f"ship {k} of the port and a town is in the sea\nwith {k * 7} other lines") for k in range(1000)]
    out = li.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"))
    got = {r.doc_id: (r.license, r.inherited_from) for r in out.collect()}
    assert {k: got[k][0] for k in range(len(WHOLE))} == {k: name for k, (_, name) in enumerate(WHOLE)}
    for k, (_, name) in enumerate(WHOLE):
        assert got[1000 + k] == (name, name and f"d{k}")
    assert not any(got[5000 + k][0] for k in range(1000))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
