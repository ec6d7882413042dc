"""Licence scan: sparse TF-IDF cosine to templates, then inheritance down the directories.

The words of the licence templates are the vocabulary; their document frequencies are counted over
all files. A unit of text is compared with each template by the cosine of the TF-IDF vectors; a word
outside the vocabulary weighs as one that no file has. The units are the lines of a file, its whole
text, and its leading block: the comment that it starts with, or else its first paragraph, as one
text, so that a notice may be wrapped in any way. There are two vocabularies: that of the one-line
notices, which all units are compared with, and that of the full texts of licences and the notices of
several lines, which leading blocks are compared with, and whole files with the full texts. Notices that differ in a
version number only stand beside each other in every wording, so that the number decides. A file
whose whole text matches is a licence file, one with a matching line or block has a licence header; a
match with the longer templates counts before one with a single line.

Only files with a key word are taken apart: a template without its key words is less than
``THRESHOLD`` long beside its whole vector, so no unit without them can reach the threshold.

A file without a licence of its own inherits from the licence file in the nearest directory above
it: the distinct directories join their ancestors with the directories of licence files, and files
join their directory. All of this is DataFrame expressions; the templates and the weights of their
words are the only literals, so what is broadcast or collected is bounded by the templates.

Defined cases: a null text is empty and has no licence of its own; a null path lies in the top
directory; of equally similar templates the name that sorts first wins, of lines the first, a line before the block, of
licence files in a directory the most similar, then the smallest path; rows that repeat an id are
read as one file; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanrules.llm.common import broadcast_if_small, whole_text
from spanrules.session import cut_lineage

THRESHOLD = 0.6
COMMON = 0.01      # of all files; more common words do not lead to the longer templates if others do

# Short notices of common licences, in the words that files carry.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-Rights-Reserved": "All rights reserved.",
}

# The notices that licences ask to put at the head of a file.
_GNU = """This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published
by the Free Software Foundation; either version {2} of the License, or (at your option) any later version. This {0} is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details. You should have received a copy
of the GNU {1} along with this {0}; if not, """
_SEE = "see <https://www.gnu.org/licenses/>."
_WRITE = "write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301, USA."
HEADERS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "BSD-3-Clause": """Copyright (c) All rights reserved. Use of this source code is governed by a BSD-style license that can
be found in the LICENSE file.""",
    "MIT": """Use of this source code is governed by an MIT-style license that can be found in the LICENSE file or at
https://opensource.org/licenses/MIT.""",
    "BSL-1.0": """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy
at http://www.boost.org/LICENSE_1_0.txt)""",
}

# the notices of the GNU licences end either way, and name a program or a library, whatever the version
for _name, _license, _version in (
        ("GPL-3.0", "General Public License", "3"), ("GPL-2.0", "General Public License", "2"),
        ("LGPL-3.0", "Lesser General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"),
        ("AGPL-3.0", "Affero General Public License", "3")):
    for _work in ("program", "library"):
        for _kind, _end in (("see", _SEE), ("write", _WRITE)):
            HEADERS[f"{_name}/{_work}/{_kind}"] = _GNU.format(_work, _license, _version) + _end

WORD = "[a-z0-9]+"

# What a leading block is, in Java's expressions: a comment between marks, or lines with a mark of their own
# (a split at the first line without), or a paragraph. No group repeats, so no block is too long for the stack.
_FIRST = r"(?s)^[\s\uFEFF]*+(?:#![^\n]*+\s*+)?(?:<\?[^\n]*+\s*+)?"
_FENCED = _FIRST + r"(?:/\*.*?(?:\*/|\z)|<!--.*?(?:-->|\z)|\(\*.*?(?:\*\)|\z)|\{-.*?(?:-\}|\z)|\"{3}.*?(?:\"{3}|\z)|'{3}.*?(?:'{3}|\z))"
_MARK = r"(?:#|//|--|;|%|!|\.\.|dnl\b|rem\b)"
_UNMARKED = rf"(?m)^(?![ \t]*(?:{_MARK}|\r?$))"
_PARAGRAPH = r"(?s)^\s*+.*?(?:\n[ \t]*\r?\n|\z)"


@cache
def long_templates() -> dict[str, str]:
    """The full texts in ``license_texts`` by licence, and the headers by ``licence/header``. The AGPL is the GPL in
    its own name."""
    texts = {p.stem: p.read_text(encoding="utf-8") for p in (Path(__file__).parent / "license_texts").glob("*.txt")}
    texts["AGPL-3.0"] = re.sub(r"(?i)(GNU\s+)(General\s+Public)", r"\1Affero \2", texts["GPL-3.0"])
    return texts | {f"{name}/header": text for name, text in HEADERS.items()}


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def weigh(templates: dict[str, str], idf: dict[str, float], threshold: float,
          common: frozenset[str] = frozenset()) -> tuple[dict, list[str]]:
    """Unit vectors of the templates, and key words: for each template its heaviest words, ``common`` ones
    last, until what is left of the vector is shorter than ``threshold``."""
    vectors, keys = {}, set()
    for name, text in templates.items():
        w = {t: n * idf[t] for t, n in Counter(words(text)).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        vectors[name] = {t: x / norm for t, x in w.items()}
        rest = 1.0
        for t, x in sorted(vectors[name].items(), key=lambda v: (v[0] in common, -v[1], v[0])):
            if math.sqrt(max(rest, 0.0)) < threshold * 0.999:
                break
            keys.add(t)
            rest -= x * x
    return vectors, sorted(keys)


def frequencies(files: DataFrame, vocabulary: list[str], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """The number of files, and of those that hold each word of the vocabulary."""
    held = F.array_intersect(F.split(F.lower(whole_text(text_col)), "[^a-z0-9]+"), F.array(*map(F.lit, vocabulary)))
    # an empty word stands for the file itself, so that one pass counts both
    rows = files.select(F.explode(F.array_union(F.array(F.lit("")), held)).alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in rows.collect()}
    return found.get("", 0), {w: found.get(w, 0) for w in vocabulary}


def _best(columns: list[tuple[str, Column]]) -> Column:
    """The largest score and its name, the name that sorts first of equals."""
    names = sorted(n for n, _ in columns)
    by = dict(columns)
    top = F.array_max(F.array(*[F.struct(by[n].alias("score"), F.lit(-i).alias("at")) for i, n in enumerate(names)]))
    return F.struct(top["score"].alias("score"),
                    F.element_at(F.array(*map(F.lit, names)), 1 - top["at"]).alias("license"))


def _key_pattern(keys: list[str]) -> str:
    by: dict[str, list[str]] = {}
    for k in keys:  # branches by first letter, few to try at each word
        by.setdefault(k[0], []).append(k[1:])
    return f"(?<![a-z0-9])(?:{'|'.join(f'{a}(?:{chr(124).join(b)})' for a, b in by.items())})(?![a-z0-9])"


def _leading_block(text: Column) -> Column:
    """The comment that a text starts with, else its first paragraph."""
    fenced = F.regexp_extract(text, _FENCED, 0)
    lines = F.split(text, _UNMARKED, 2)[0]
    return (F.when(fenced != "", fenced)
            .when(text.rlike(rf"^\s*+{_MARK}"), F.regexp_replace(lines, "(?m)^[ \t]*(?:dnl|rem)\\b", ""))
            .otherwise(F.regexp_extract(text, _PARAGRAPH, 0)))


def _scores(units: DataFrame, vectors: dict[str, dict[str, float]], idf: dict[str, float], unseen: float,
            headers: list[str] = []) -> DataFrame:
    """``id, unit, best``: of the ``id, unit, text`` of ``units`` the best template; ``headers`` are not
    compared with whole files (unit 0)."""
    counts = (units.select("id", "unit", F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word"))
              .groupBy("id", "unit", "word").agg(F.count(F.lit(1)).alias("tf")))
    names = sorted(vectors)
    table = units.sparkSession.createDataFrame(
        [(w, idf[w], *[float(vectors[t].get(w, 0.0)) for t in names]) for w in sorted(idf)],
        "known string, idf double, " + ", ".join(f"t{i} double" for i in range(len(names))))
    weight = F.col("tf") * F.coalesce("idf", F.lit(unseen))
    sums = (counts.join(F.broadcast(table), F.col("word") == F.col("known"), "left")  # as small as the templates
            .groupBy("id", "unit")
            .agg(F.sqrt(F.sum(weight * weight)).alias("norm"),
                 *[F.sum(weight * F.coalesce(f"t{i}", F.lit(0.0))).alias(f"t{i}") for i in range(len(names))]))
    # rounded, so that the order of the sums decides nothing
    scores = [(t, F.round(F.col(f"t{i}") / F.col("norm"), 6)) for i, t in enumerate(names)]
    return sums.select("id", "unit", _best([(t, F.when(F.col("unit") != 0, x) if t in headers else x)
                                            for t, x in scores]).alias("best"))


def own_licenses(files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD,
                 id_col: str = "id", text_col: str = "text", longer: dict[str, str] | None = None) -> DataFrame:
    """``id, license, score, how`` of the files with a licence file's text or a licence header; ``longer``
    are the full texts and headers, by default all of ``long_templates`` beside ``TEMPLATES`` and else none."""
    if longer is None:
        longer = long_templates() if templates is TEMPLATES else {}
    short_words = {w for t in templates.values() for w in words(t)}
    long_words = {w for t in longer.values() for w in words(t)}
    n, df = frequencies(files, sorted(short_words | long_words), text_col)
    unseen = math.log(1 + n) + 1
    idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in df.items()}
    vectors, keys = weigh(templates, idf, threshold)
    has_key = _key_pattern(keys)
    texts = files.select(F.col(id_col).alias("id"), F.lower(whole_text(text_col)).alias("text"))
    marked = texts.where(F.col("text").rlike(has_key))
    # unit 0 is the file, -1 its leading block, lines count from 1
    lines = marked.select("id", F.posexplode(F.split("text", "\r?\n")).alias("unit", "text"))
    blocks = marked.select("id", F.lit(-1).alias("unit"), _leading_block(F.col("text")).alias("text"))
    units = (lines.withColumn("unit", F.col("unit") + 1).unionByName(blocks).where(F.col("text").rlike(has_key))
             .unionByName(marked.select("id", F.lit(0).alias("unit"), "text")))
    scores = _scores(units, vectors, {w: idf[w] for w in sorted(short_words)}, unseen).withColumn("long", F.lit(False))
    if longer:
        common = frozenset(w for w in long_words if df[w] > COMMON * n)
        long_vectors, long_keys = weigh(longer, idf, threshold, common)
        marked = texts.where(F.col("text").rlike(_key_pattern(long_keys)))
        units = marked.select("id", F.lit(0).alias("unit"), "text").unionByName(
            marked.select("id", F.lit(-1).alias("unit"), _leading_block(F.col("text")).alias("text")))
        found = _scores(units, long_vectors, {w: idf[w] for w in sorted(long_words)}, unseen,
                        [t for t in longer if t.endswith("/header")])
        scores = scores.unionByName(found.select("id", "unit", F.lit(True).alias("long"), F.struct(
            F.col("best.score").alias("score"), F.split("best.license", "/")[0].alias("license")).alias("best")))
    whole, score = F.col("unit") == 0, F.col("best.score").alias("score")
    at = F.when(F.col("unit") < 0, -(1 << 40)).otherwise(-F.col("unit").cast("long")).alias("line")
    ranked = scores.where(F.col("best.score") >= threshold).groupBy("id").agg(
        F.max(F.when(whole, F.struct("long", score, F.col("best.license").alias("license")))).alias("file"),
        F.max(F.when(~whole, F.struct("long", score, at, F.col("best.license").alias("license")))).alias("header"))
    return cut_lineage(ranked.select(
        "id", F.coalesce("file.license", "header.license").alias("license"),
        F.coalesce("file.score", "header.score").alias("score"),
        F.when(F.col("file").isNotNull(), "file").otherwise("header").alias("how")))


def _directory(path: Column) -> Column:
    """The directory of a path, without a slash at the end; the top directory is empty."""
    return F.regexp_replace(F.coalesce(path, F.lit("")), "/?[^/]*$", "")


def scan(files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD,
         id_col: str = "id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """One row per file: ``id, path, license, how`` (file, header, inherited or null), ``score`` (of the
    text that matched) and ``license_dir`` (the directory that an inherited licence comes from)."""
    own = own_licenses(files.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), templates, threshold)
    named = files.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"))
    rows = cut_lineage(named.join(broadcast_if_small(own, 64), "id", "left")
                       .withColumn("dir", _directory(F.col("path"))))
    # of a directory's licence files the most similar counts, then the smallest path
    source = cut_lineage(
        rows.where("how = 'file'").groupBy("dir")
        .agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("m"))
        .select(F.col("dir").alias("license_dir"), F.col("m.license").alias("from_dir"),
                (-F.col("m.s")).alias("dir_score")))
    # every directory above one: its first 0, 1, 2 ... parts
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    above = (rows.where("license IS NULL").select("dir").distinct()
             .select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"), parts.alias("parts"))
             .select("dir", "depth", F.array_join(F.expr("slice(parts, 1, depth)"), "/").alias("license_dir")))
    nearest = cut_lineage(
        above.join(broadcast_if_small(source, 96), "license_dir")
        .groupBy("dir").agg(F.max(F.struct("depth", "license_dir", "from_dir", "dir_score")).alias("m"))
        .select("dir", "m.license_dir", "m.from_dir", "m.dir_score"))
    out = rows.join(broadcast_if_small(nearest, 128), "dir", "left")
    bare = F.col("license").isNull()
    return out.select(
        F.col("id").alias(id_col), F.col("path").alias(path_col),
        F.coalesce("license", "from_dir").alias("license"),
        F.when(bare & F.col("from_dir").isNotNull(), "inherited").otherwise(F.col("how")).alias("how"),
        F.coalesce("score", "dir_score").alias("score"),
        F.when(bare, F.col("license_dir")).alias("license_dir"))
