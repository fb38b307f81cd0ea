"""Licence notices, headers and full texts against a brute-force TF-IDF."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemill.llm import licenses

FULL = {t.license: t.text for t in licenses.TEMPLATES if t.full}
GPL3 = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
PROSE = "\n".join(f"qorvan plimteth usk drovanel {i} bexim taluth grenn ovaskel" for i in range(60))
NOTICES = [
    ("SPDX-License-Identifier: MIT", "MIT"),
    ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    ("SPDX-License-Identifier: GPL-3.0-only", "GPL-3.0"),
    ("# SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"),
    ("Copyright (c) 2021 Ann Example. Released under the MIT License. See LICENSE for details.", "MIT"),
    (GPL3, "GPL-3.0"),
    (GPL3.replace("version 3", "version 2"), "GPL-2.0"),
    (MPL, "MPL-2.0"),
    ("https://creativecommons.org/licenses/by-sa/4.0/", "CC-BY-SA-4.0"),
    ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("Creative Commons Attribution-NonCommercial 4.0 International Public License", "CC-BY-NC-4.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("A license is a thing one may like or not, says who.", None),
    ("Released under the license.", None),
    ("SPDX-License-Identifier: Foobar-1.0", None),
    ("See the license for more details.", None),
]


def brute_scores(texts):
    """Best licence and score of each text, by dense loops."""
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    words = lambda t: Counter(re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", low(t)))
    known = [words(t.text) for t in licenses.TEMPLATES]
    df = Counter(w for c in known for w in c)
    idf = lambda w: math.log((len(known) + 1) / (df[w] + 1)) + 1

    def unit(c):
        v = {w: (1 + math.log(k)) * idf(w) for w, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    sides, out = [unit(c) for c in known], {}
    for text in texts:
        mine, best = unit(words(text)), []
        for t, v in zip(licenses.TEMPLATES, sides):
            s = sum(x * v.get(w, 0) for w, x in mine.items())
            if s >= licenses.THRESHOLD and (t.full or any(re.fullmatch(licenses.NAME, w) for w in mine if w in v)):
                best.append((-round(s, 6), t.license))
        if best:
            out[text] = (min(best)[1], -min(best)[0])
    return out


def test_lines_against_brute_force(spark):
    texts = [n for n, _ in NOTICES] + list(FULL.values()) + [PROSE]
    got = licenses.match_lines(spark.createDataFrame([(t,) for t in texts], "line string")).collect()
    assert {r["line"]: (r["license"], round(r["score"], 6)) for r in got} == brute_scores(texts)


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [(i, f"alone{i}/x", text) for i, (text, _) in enumerate(NOTICES)]
    rows += [(100 + i, f"inside{i}/x", f"{PROSE}\n{text}\n{PROSE}") for i, (text, _) in enumerate(NOTICES)]
    for i, (name, text) in enumerate(sorted(FULL.items())):
        rows += [(1000 + 10 * i, f"full-{name}/LICENSE", text.replace("<year> <copyright holders>", "1999 Ann Example"))]
        rows += [(1001 + 10 * i, f"full-{name}/deep/er/a.txt", PROSE)]
        rows += [(1002 + 10 * i, f"header-{name}/a.c", f"/*\n{text}*/\n{PROSE}\n{PROSE}\n{PROSE}")]
    rows += [(5000, "gpl/header/COPYING", GPL3), (5001, "gpl/header/x", PROSE), (5002, "code/a", f"{MPL}\n{PROSE}"), (5003, "code/b", PROSE)]
    docs = spark.createDataFrame(rows, "doc_id long, place string, text string")
    return {r["doc_id"]: r for r in licenses.scan(docs, F.col("place")).collect()}


@pytest.mark.parametrize("offset", [0, 100])
def test_notices_alone_and_inside_texts(scanned, offset):
    assert [scanned[offset + i]["license"] for i in range(len(NOTICES))] == [name for _, name in NOTICES]


def test_full_texts_as_files_and_inside_code(scanned):
    for i, name in enumerate(sorted(FULL)):
        file, below, header = (scanned[1000 + 10 * i + k] for k in range(3))
        assert (file["license"], file["origin"]) == (name, "own")
        assert (below["license"], below["origin"], below["directory"]) == (name, "inherited", f"full-{name}")
        assert (header["license"], header["origin"]) == (name, "own")


def test_header_file_speaks_for_its_directory_and_code_does_not(scanned):
    assert (scanned[5001]["license"], scanned[5001]["directory"]) == ("GPL-3.0", "gpl/header")
    assert scanned[5002]["license"] == "MPL-2.0" and scanned[5003]["license"] is None


def test_a_notice_in_a_flat_directory_is_that_files_alone(spark):
    """As in the test tables, where a directory is a source and a language: short documents with a
    notice decide nothing for their neighbours; a full licence text or a licence file does."""
    rows = [(i, f"src/en/{i}", PROSE) for i in range(40)] + [(50, "src/en/50", "Released under the MIT License."), (51, "src/en/51", MPL)]
    rows += [(60, "src/de/60", GPL3 + "".join(t for n, t in FULL.items() if n == "GPL-3.0"))] + [(61, "src/de/61", PROSE)]
    rows += [(70, "src/fr/license.md", "Released under the MIT License."), (71, "src/fr/71", PROSE)]
    docs = spark.createDataFrame(rows, "doc_id long, place string, text string")
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in licenses.scan(docs, F.col("place")).collect()}
    assert all(got[i] == (None, "none") for i in range(40))
    assert got[50] == ("MIT", "own") and got[51] == ("MPL-2.0", "own")
    assert got[71] == ("MIT", "inherited")


def test_a_large_directory_is_not_one_task(spark):
    """The table of directories is written before it is joined, so that Spark knows how small it is."""
    docs = spark.range(2_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("one/"), "id").alias("place"),
        F.when(F.col("id") == 7, FULL[sorted(FULL)[0]]).otherwise("plain words").alias("text"),
    )
    out = licenses.scan(docs, F.col("place"))
    assert out.where("origin = 'inherited'").count() == 1_999
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [dir" in plan
