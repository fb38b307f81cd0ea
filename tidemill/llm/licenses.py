"""License scans: sparse TF-IDF cosine to templates, then inheritance from directories.

Templates are SPDX tags, names, standard headers and full licence texts. From every text
that speaks of a licence, three kinds of candidates are compared with them: sentences of the
lines that do so, sliding blocks of lines around those lines, and the whole text. All are
vectors of words, weighted by how few of the templates have the word, so a verdict does not
depend on the other documents. A document takes the licence of its best candidate. A
full licence text, or a file named as a licence file that is little else than notices, speaks
for its directory; documents without a licence of their own take that of the nearest
directory above them that has one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import WORD, ascii_lower, keep, let, word_count


class Template(NamedTuple):
    license: str
    text: str
    full: bool = False  # a full licence text


# The names by which licences are recognised.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License"],
    "CC0-1.0": ["Creative Commons CC0 1.0 Universal", "CC0 1.0 Universal Public Domain Dedication"],
    "ISC": ["ISC License"],
    "MIT": ["MIT License", "The MIT License (MIT)"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0 license"],
}
GNU = {
    "GPL": ("GNU General Public License", ("2", "3")),
    "LGPL": ("GNU Lesser General Public License", ("2.1", "3")),
    "AGPL": ("GNU Affero General Public License", ("3",)),
}
CC = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
# Notices and standard headers.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms is permitted under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0."),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
        in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    ),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
        the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
]
GNU_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the
    {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option)
    any later version."""
GNU_WARRANTY = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
    even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more
    details. You should have received a copy of the {name} along with this program. If not, see
    <https://www.gnu.org/licenses/>."""


def _templates() -> list[Template]:
    out = [Template(*n) for n in NOTICES]

    def named(spdx: str, names: list[str], ids: list[str]) -> None:
        out.extend(Template(spdx, name) for name in names)
        out.extend(Template(spdx, f"{tag}: {i}") for i in ids for tag in ("SPDX-License-Identifier", "License"))

    for spdx, names in NAMES.items():
        named(spdx, names, [spdx])
    for short, (name, versions) in GNU.items():
        for v in versions:
            spdx = f"{short}-{v}" if "." in v else f"{short}-{v}.0"
            names = [f"{name}, version {v}", f"{name} v{v}", f"GNU {short} version {v} license", f"{short}v{v} license"]
            named(spdx, names, [spdx, f"{spdx}-only", f"{spdx}-or-later"])
            header = GNU_HEADER.format(name=name, v=v)
            out += [Template(spdx, header), Template(spdx, f"{header} {GNU_WARRANTY.format(name=name)}")]
    for code, words in CC.items():
        for v in ("2.0", "2.5", "3.0", "4.0"):
            full = words.replace("NoDerivatives", "NoDerivs") if v != "4.0" else words
            kind = "International" if v == "4.0" else "Unported" if v == "3.0" else "Generic"
            names = [f"Creative Commons {full} {v} {kind} License", f"Licensed under CC {code} {v}"]
            if v == "4.0":
                names.append(f"Creative Commons {full} {v} {kind} Public License")
            names.append(f"https://creativecommons.org/licenses/{code.lower()}/{v}/")
            named(f"CC-{code}-{v}", names, [f"CC-{code}-{v}"])
    texts = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    return out + [Template(p.stem, p.read_text("utf-8"), True) for p in texts]


TEMPLATES = _templates()
CUE = r"(?i)licen[cs]e|copyright|spdx|public domain|creative commons|redistribut|\bcc0\b|\bcc[ -]by\b"
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
# A word of a licence's name: a notice that has none in common with a template is not one of it.
NAME = r"(?:apache|bsd|cc0|mit|mpl|isc|l?gpl|agpl|gnu|mozilla|by|cc-by|attribution)(?:[v.-].*|v?\d.*)?|creativecommons.org"
SENTENCE = r"(?<=[.;!?])[\x20\x09-\x0D]+"
THRESHOLD = 0.6
FILE_THRESHOLD = 0.8  # of a whole text to a full licence text, or of what makes up most of a text
# Names of licence files, with or without an ending.
FILE_NAME = r"(?i)^(licen[cs]es?|unlicen[cs]e|copying|copyright|notice)([.-].*)?$"
FILE_SHARE = 50  # percent of a licence file's words that stand in lines about licences
BLOCKS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)  # lines; a block slides by a quarter of them
WHOLE, BLOCK, PIECE = 0, 1, 2


def tokens(line: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(line), F.lit(TOKEN), F.lit(0))


class Index(NamedTuple):
    """Unit vectors of the templates, turned round: per token its weight and who has it."""

    rows: list[tuple[str, float, list[tuple[int, float, bool]]]]
    unseen: float  # weight of a token that no template has


def index(templates: list[Template]) -> Index:
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    counts = [Counter(re.findall(TOKEN, t.text.encode().translate(low).decode())) for t in templates]
    n, df = len(templates), Counter(token for c in counts for token in c)
    idf = {token: math.log((n + 1) / (k + 1)) + 1 for token, k in df.items()}
    entries: dict[str, list[tuple[int, float, bool]]] = {token: [] for token in sorted(idf)}
    for i, c in enumerate(counts):
        w = {token: (1 + math.log(k)) * idf[token] for token, k in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        for token, x in w.items():
            entries[token].append((i, x / norm, re.fullmatch(NAME, token) is not None))
    return Index([(token, idf[token], e) for token, e in entries.items()], math.log(n + 1) + 1)


def match_tokens(found: DataFrame, templates: list[Template] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``id, license, score, full`` for rows (``id, tokens``; ids are distinct) near enough to
    a template: the best one, ties by name; ``full`` is the best score to a full text.

    Counts weigh by their logarithm, so that frequent small words of long texts do not
    decide. Rows whose words outside the templates alone keep every cosine below the
    threshold are left out before the templates are joined."""
    spark, known = found.sparkSession, index(templates)
    rows = F.broadcast(spark.createDataFrame(known.rows, "token string, idf double, e array<struct<t:int,v:double,named:boolean>>"))
    names = spark.createDataFrame([(i, t.license, t.full) for i, t in enumerate(templates)], "t int, license string, whole boolean")
    tf = found.select("id", F.explode("tokens").alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))
    weight = (1 + F.log(F.col("tf").cast("double"))) * F.coalesce("idf", F.lit(known.unseen))
    weighted = tf.join(rows.select("token", "idf"), "token", "left")
    weighted = keep(weighted.select("id", "token", weight.alias("w"), F.col("idf").isNotNull().alias("seen")), "tfidf")
    square = F.col("w") * F.col("w")
    norms = weighted.groupBy("id").agg(F.sqrt(F.sum(square)).alias("norm"), F.sum(F.when(F.col("seen"), square)).alias("inside"))
    able = norms.where(F.col("inside") >= (threshold * F.col("norm")) ** 2 * (1 - 1e-6)).select("id", "norm")
    shared = weighted.where("seen").join(able, "id").join(rows.select("token", "e"), "token")
    shared = shared.select("id", (F.col("w") / F.col("norm")).alias("w"), F.inline("e"))
    scores = shared.groupBy("id", "t").agg(F.round(F.sum(F.col("w") * F.col("v")), 9).alias("s"), F.max("named").alias("named"))
    scores = scores.where(F.col("s") >= threshold).join(F.broadcast(names), "t").where("named OR whole")
    best = scores.groupBy("id").agg(
        F.min(F.struct((-F.col("s")).alias("s"), "license")).alias("b"), F.max(F.when(F.col("whole"), F.col("s"))).alias("full")
    )
    return best.select("id", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), "full")


def match_lines(lines: DataFrame, templates: list[Template] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``line, license, score`` for different lines (column ``line``) near enough to a template."""
    found = lines.select(F.col("line").alias("id"), tokens(F.col("line")).alias("tokens")).dropDuplicates(["id"])
    return match_tokens(found, templates, threshold).select(F.col("id").alias("line"), "license", "score")


def candidates(lines: Column, vocabulary: Column) -> Column:
    """Array of ``kind, tokens`` of a text's lines: the whole, blocks and sentences.

    A block has a line with a cue; if it has more than one line, at least half of the
    different words of each stand in templates."""

    def blocks(parts: Column) -> Column:
        def of(size: int) -> Column:
            starts = F.sequence(F.lit(1), F.size(parts) - size + 1, F.lit(max(1, size // 4)))
            runs = F.transform(F.when(F.size(parts) >= size, starts).otherwise(F.array().cast("array<int>")), lambda i: F.slice(parts, i, F.lit(size)))
            told = lambda run: F.exists(run, lambda p: p["cue"])
            dense = lambda run: F.forall(run, lambda p: p["fit"]) if size > 1 else F.lit(True)
            return F.filter(runs, lambda run: told(run) & dense(run))

        runs = F.flatten(F.array(*[of(size) for size in BLOCKS]))
        return F.transform(runs, lambda run: F.struct(F.lit(BLOCK).alias("kind"), F.flatten(run["t"]).alias("tokens")))

    def marked(parts: Column) -> Column:
        words = F.array_intersect(F.flatten(parts["t"]), vocabulary)
        fit = lambda p, known: 2 * F.size(F.array_intersect(p["t"], known)) >= F.size(F.array_distinct(p["t"]))
        return let(words, lambda known: F.transform(parts, lambda p: F.struct(p["t"].alias("t"), p["cue"].alias("cue"), fit(p, known).alias("fit"))))

    said = F.filter(lines, lambda line: line.rlike(CUE))
    pieces = F.flatten(F.transform(said, lambda line: F.filter(F.split(line, SENTENCE), lambda s: s.rlike(CUE))))
    pieces = F.transform(pieces, lambda s: F.struct(F.lit(PIECE).alias("kind"), tokens(s).alias("tokens")))
    parts = F.transform(lines, lambda line: F.struct(tokens(line).alias("t"), line.rlike(CUE).alias("cue")))
    parts = F.filter(parts, lambda p: F.size(p["t"]) > 0)
    whole = lambda p: F.array(F.struct(F.lit(WHOLE).alias("kind"), F.flatten(p["t"]).alias("tokens")))
    return F.array_distinct(let(parts, lambda p: F.concat(whole(p), let(marked(p), blocks), pieces)))


def scan(docs: DataFrame, path: Column, templates: list[Template] = TEMPLATES) -> DataFrame:
    """Per row: ``doc_id, path, license, score, origin`` (own, inherited, none) and
    ``directory``, the one a licence is inherited from.

    ``path`` is a document's path, parts joined by ``/``. Whole texts are scanned; a NULL or
    empty text has no licence of its own, a NULL path lies in the root directory. A document
    speaks for its directory if it is a full licence text, or if it is named as a licence file
    (``FILE_NAME``) and is mostly notice; a notice in any other file is that file's alone. Two
    licence files of a directory: the better match, then the name, decides. Repeated rows
    each get a row, no rows give none. Columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(path, F.lit("")).alias("path"), text.alias("_t"))
    some = F.filter(F.split("_t", "\n"), lambda line: line.rlike(WORD))
    told = F.when(F.col("_t").rlike(CUE), some).otherwise(F.array().cast("array<string>"))
    # rows with equal id, path and text share a key, and with it a licence
    key = F.md5(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.char_length("path"), "path", "_t"))
    rows = rows.select("doc_id", "path", told.alias("lines"), word_count(F.col("_t")).alias("n_words"), key.alias("key"))
    named = F.substring_index("path", "/", -1).rlike(FILE_NAME)
    rows = keep(rows.withColumns({"dir": F.regexp_replace("path", r"(?s)/?[^/]*$", ""), "named": named}), "notices")
    vocabulary = spark.createDataFrame([([r[0] for r in index(templates).rows],)], "vocabulary array<string>")
    found = rows.where(F.size("lines") > 0).join(F.broadcast(vocabulary))  # one row
    found = found.select("key", "dir", "named", "n_words", "lines", F.inline(candidates(F.col("lines"), F.col("vocabulary"))))
    noted = F.aggregate(
        F.array_distinct(F.filter("lines", lambda line: line.rlike(CUE))), F.lit(0), lambda a, line: a + F.regexp_count(line, F.lit(WORD))
    )
    mostly = 100 * noted >= FILE_SHARE * F.col("n_words")
    most = 100 * F.size("tokens") >= FILE_SHARE * F.size(F.flatten(F.transform("lines", tokens)))
    found = found.where(F.size("tokens") > 0).select(
        "key", "dir", "named", "kind", F.md5(F.array_join("tokens", " ")).alias("id"), "tokens", mostly.alias("mostly"), most.alias("most")
    )
    found = keep(found, "candidates")
    matches = keep(match_tokens(found.select("id", "tokens").dropDuplicates(["id"]), templates), "matches")
    hits = found.drop("tokens").join(matches, "id")
    near_full = (F.col("kind") == WHOLE) & (F.col("full") >= FILE_THRESHOLD)
    near_most = (F.col("kind") != WHOLE) & F.col("most") & (F.col("score") >= FILE_THRESHOLD)
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("license").alias("license")))
    speaks = F.max(F.coalesce(near_full, F.lit(False)) | (F.col("named") & (F.col("mostly") | near_most)))
    own = keep(hits.groupBy("key", "dir").agg(best.alias("b"), speaks.alias("speaks")), "own")
    declared = own.where("speaks").groupBy("dir").agg(F.min("b").alias("b"))
    # directories and those above them, down from each directory that has documents
    dirs = rows.select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.transform(
        F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))),
        lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("up")),
    )
    ladder = dirs.select("dir", F.inline(above))
    near = ladder.join(declared.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(
        F.max_by(F.struct("up", "b"), "depth").alias("d")
    )
    # written: Spark then knows its size, and can split a hot directory's side of the join
    near = near.select("dir", F.col("d.up").alias("directory"), F.col("d.b.license").alias("_theirs"), (-F.col("d.b.s")).alias("_score"))
    near = keep(near, "near")
    mine = own.select("key", F.col("b.license").alias("_own"), (-F.col("b.s")).alias("_own_score"))
    out = rows.join(near, "dir", "left").join(mine, "key", "left")
    has = F.col("_own").isNotNull()
    return out.select(
        "doc_id", "path", F.coalesce("_own", "_theirs").alias("license"),
        F.when(has, F.col("_own_score")).otherwise(F.col("_score")).alias("score"),
        F.when(has, "own").when(F.col("_theirs").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~has, F.col("directory")).alias("directory"),
    )


def run(spark, sf: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id``."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string"))
    return scan(docs, path)
