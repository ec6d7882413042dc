import math
import re
from collections import Counter

from spanrules.llm import licenses

SF = "/root/testdata/sf0.01"


def brute(files):
    """License, how and score of every file by full vectors, without key words or joins."""
    vocabulary = {w for t in licenses.TEMPLATES.values() for w in licenses.words(t)}
    texts = {i: (t or "").lower() for i, _, t in files}
    n = len(files)
    df = Counter(w for _, _, t in files for w in vocabulary & set(licenses.words(t or "")))
    idf = {w: math.log((1 + n) / (1 + df[w])) + 1 for w in vocabulary}

    def vector(text):
        w = {t: c * idf.get(t, math.log(1 + n) + 1) for t, c in Counter(licenses.words(text)).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()} if norm else {}

    known = {k: vector(t) for k, t in licenses.TEMPLATES.items()}

    def best(text):
        v = vector(text)
        return min(((-round(sum(x * v.get(t, 0) for t, x in k.items()), 6), name) for name, k in known.items()))

    own, dirs = {}, {}
    for i, path, _ in files:
        score, name = best(texts[i])
        if -score >= licenses.THRESHOLD:
            own[i] = (name, "file", -score)
            where = (path or "").rpartition("/")[0]
            dirs.setdefault(where, []).append((score, path, name))
            continue
        lines = [best(x) for x in re.split("\r?\n", texts[i])]
        score = min(s for s, _ in lines)
        if -score >= licenses.THRESHOLD:
            own[i] = (next(name for s, name in lines if s == score), "header", -score)
    out = {}
    for i, path, _ in files:
        if i in own:
            out[i] = own[i]
            continue
        where, out[i] = (path or "").rpartition("/")[0], (None, None, None)
        while True:
            if where in dirs:
                score, _, name = min(dirs[where])
                out[i] = (name, "inherited", -score)
                break
            if not where:
                break
            where = where.rpartition("/")[0]
    return out


def run(spark, files):
    df = licenses.scan(spark.createDataFrame([(i, p, t, "x", 3) for i, p, t in files],
                                             "id long, path string, text string, license string, unit int"))
    assert df.columns == ["id", "path", "license", "how", "score", "license_dir"]
    return {r["id"]: r for r in df.collect()}


def check(spark, files):
    got, want = run(spark, files), brute(files)
    assert {i: (r["license"], r["how"]) for i, r in got.items()} == {i: w[:2] for i, w in want.items()}
    for i, (_, _, score) in want.items():
        assert (got[i]["score"] is None) == (score is None) and abs((score or 0) - (got[i]["score"] or 0)) < 2e-6
    return got


MIT, GPL = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]


def test_headers_files_and_inheritance(spark):
    files = [
        (1, "a/LICENSE", MIT), (2, "a/b/c/x.txt", "nothing here"), (3, "a/b/LICENSE", GPL),
        (4, "a/b/c/d/y.txt", "still nothing"), (5, "z/own.txt", "some code\r\n" + GPL.upper() + "\nmore code" * 20),
        (6, "z/none.txt", "the version of the work"), (7, None, None), (8, "a/q.txt", ""), (9, "ab/q.txt", "prefix of a name"),
        (10, "z/long.txt", "word " * 50_000 + "\n" + licenses.TEMPLATES["CC-BY-NC-4.0"]),
        (11, "t/1", MIT), (12, "t/0", "All rights reserved."), (13, "t/x", "two licence files"),
        (14, "/abs/x", "absolute"), (15, "z/mit.txt", "released under the mit licence, license"),
        (16, "w/LICENSE", "This work is licensed under the GNU General Public License, version 9."), (17, "w/x", "-")]
    got = check(spark, files)
    assert (got[2]["license"], got[2]["license_dir"]) == ("GPL-3.0", "a/b")
    assert (got[4]["license"], got[8]["license"], got[9]["license"]) == ("GPL-3.0", "MIT", None)
    assert (got[5]["how"], got[10]["license"]) == ("header", "CC-BY-NC-4.0")
    assert got[13]["license"] == "All-Rights-Reserved"      # equally similar: the smaller path
    assert got[16]["license"] in ("GPL-2.0", "GPL-3.0")


def test_top_directory_and_repeated_rows(spark):
    got = check(spark, [(1, "LICENSE", MIT), (2, "x/y/z.txt", "code"), (3, "w.txt", "code")])
    assert {r["license"] for r in got.values()} == {"MIT"}
    df = licenses.scan(spark.createDataFrame([(1, "a/L", MIT)] * 2 + [(2, "a/x", "code")] * 3,
                                             "id long, path string, text string"))
    assert sorted((r["id"], r["license"]) for r in df.collect()) == [(1, "MIT")] * 2 + [(2, "MIT")] * 3


def test_equally_similar_templates_take_the_first_name(spark):
    df = spark.createDataFrame([(1, "a", "free to use")], "id long, path string, text string")
    assert licenses.scan(df, {"B": "free to use", "A": "use free to"}).first()["license"] == "A"


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "id long, path string, text string")).count() == 0


def test_real_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    check(spark, [(r["doc_id"], f"{r['lang']}/{r['source']}/{r['doc_id']}.txt", r["text"]) for r in docs])


def wrapped(text, mark, width):
    out, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            out.append(line)
            line = ""
        line += w + " "
    return "\n".join(mark + x for x in [*out, line])


def test_licence_texts_and_wrapped_headers(spark):
    texts = licenses.long_templates()
    docs = [(r["doc_id"], f"docs/{r['doc_id']}", r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()]
    mit = texts["MIT"].replace("MIT License", "The MIT License (MIT)").replace("(c)", "(c) 2019 Some Body and contributors")
    bsd = texts["BSD-3-Clause"].replace("(c)", "(c) 2001-2011, Example Inc").replace("\n\n", "\r\n\r\n")
    gpl = "widget.c - draws widgets\nCopyright (C) 2020 Some Body <some@body.example>\n\n" + licenses.HEADERS["GPL-3.0/program/see"].replace("program;", "program:")
    apache = "Copyright 2021 The Example Authors. All rights reserved.\n" + licenses.HEADERS["Apache-2.0"]
    code = "\n\nint value = compute(other, thing);\nwhile (value) { step(value); }" * 40
    files = [
        (10**6 + 1, "m/LICENSE", mit), (10**6 + 2, "m/src/a.c", "int main;"),
        (10**6 + 3, "b/COPYING", bsd), (10**6 + 4, "g/COPYING", texts["GPL-2.0"]), (10**6 + 5, "p/LICENSE", texts["Apache-2.0"]),
        (10**6 + 6, "p/x/y.py", "x = 1"), (10**6 + 7, "h/a.c", "/*\n" + wrapped(gpl, " * ", 60) + "\n */" + code),
        (10**6 + 8, "h/b.py", "#!/usr/bin/env python\n" + wrapped(apache, "# ", 50) + code),
        (10**6 + 9, "h/c.cc", wrapped("Copyright 2010 The Project Authors. " + licenses.HEADERS["MPL-2.0"], "// ", 40) + code),
        (10**6 + 10, "h/d.html", "<!--\n" + wrapped(licenses.TEMPLATES["GPL-2.0"], "  ", 30) + "\n-->" + code),
        (10**6 + 11, "h/e.c", "/* draws widgets */" + code), (10**6 + 12, "a/COPYING", texts["AGPL-3.0"]),
        (10**6 + 13, "h/f.py", "# a remark\n" * 20_000 + code)]
    got = run(spark, docs + files)
    own = {i - 10**6: (got[i]["license"], got[i]["how"]) for i, _, _ in files}
    assert own == {
        1: ("MIT", "file"), 2: ("MIT", "inherited"), 3: ("BSD-3-Clause", "file"), 4: ("GPL-2.0", "file"),
        5: ("Apache-2.0", "file"), 6: ("Apache-2.0", "inherited"), 7: ("GPL-3.0", "header"), 8: ("Apache-2.0", "header"),
        9: ("MPL-2.0", "header"), 10: ("GPL-2.0", "header"), 11: (None, None), 12: ("AGPL-3.0", "file"), 13: (None, None)}


def test_the_version_of_a_notice_decides(spark):
    docs = [(r["doc_id"], f"docs/{r['doc_id']}", r["text"])
            for r in spark.read.parquet(f"{SF}/documents.parquet").limit(200).collect()]
    code = "\n\nint value = compute(other, thing);\nwhile (value) { step(value); }" * 40
    see = "If not, see <https://www.gnu.org/licenses/>."
    write = "if not, write to the Free Software Foundation, Inc., 59 Temple Place, Suite 330, Boston, MA 02111-1307 USA"
    files, want = [], {}
    for name in ("General", "Lesser General", "Affero General"):
        for version in {"General": ("2", "3"), "Lesser General": ("2.1", "3"), "Affero General": ("3",)}[name]:
            for end in (see, write):
                for work in ("program", "library", "file"):
                    text = (f"Copyright (C) 2012 Some Body\n\nThis {work} is free software: you can redistribute it and/or modify it under "
                            f"the terms of the GNU {name} Public License as published by the Free Software Foundation; either "
                            f"version {version} of the License, or (at your option) any later version.\n\nThis {work} is distributed "
                            "in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
                            "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
                            f"{name} Public License for more details.\n\nYou should have received a copy of the GNU {name} Public "
                            f"License along with this {work}. {end}")
                    i = 10**6 + len(files)
                    files.append((i, f"s/{i}.c", "/*\n" + wrapped(text, " * ", 70) + "\n */" + code))
                    short = {"General": "GPL", "Lesser General": "LGPL", "Affero General": "AGPL"}[name]
                    want[i] = (f"{short}-{version}{'' if '.' in version else '.0'}", "header")
    got = run(spark, docs + files)
    assert {i: (got[i]["license"], got[i]["how"]) for i in want} == want
