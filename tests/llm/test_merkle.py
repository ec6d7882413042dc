import hashlib
import random
import zlib

import duckdb
import pytest

from spanrules.llm import merkle

SF = "/root/testdata/sf0.01"
NAMES = ("doc_id", "source", "lang", "n_chars", "text")


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, fanout=3):
    """Root, and for each leaf its steps (left, right)."""
    paths, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, under = [], []
        for i in range(0, len(nodes), fanout):
            run = nodes[i:i + fanout]
            for k in range(len(run)):
                for x in at[i + k]:
                    paths[x].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(h(run))
            under.append([x for a in at[i:i + fanout] for x in a])
        nodes, at = up, under
    return nodes[0], paths


def brute(rows):
    def tampered(r):
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        return (*r[:4], r[4].replace("\n", "") if hit and r[4] is not None else r[4])

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    out, sub = [], {}
    for s in order:
        data = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, h(map(part, r))))
        sub[s] = (data, *tree([h(map(part, r)) for r in data]))
    root, tops = tree([sub[s][1] for s in order])
    for s, above in zip(order, tops):
        data, subroot, paths = sub[s]
        for r, path in zip(data, paths):
            steps = path + above
            x = h(map(part, tampered(r)))
            for a, b in steps:
                x = h([a, x, b])
            out.append((r[0], h(map(part, r)), subroot, root, h(a + b for a, b in steps), x, x == root))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def test_matches_sql_and_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mine = merkle.tampered_documents(docs)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    sql = con.sql(merkle.oracle_sql())
    assert set(sql.columns) == set(mine.columns)
    rows = got(mine)
    assert rows == sorted((tuple(r[sql.columns.index(c)] for c in mine.columns) for r in sql.fetchall()), key=str)
    assert rows == brute([tuple(r[n] for n in NAMES) for r in docs.collect()])
    assert {r[6] for r in rows} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [2], [3], [4], [9, 1], [10, 27, 28], [1, 1, 1, 1], [82, 3, 1, 2]])
def test_shapes(spark, sizes):
    rows = [(i * 7 % 101 + 1000 * g, f"s{g}", "en", i, "a\nb" if i % 3 else None) for g, n in enumerate(sizes) for i in range(n)]
    random.Random(4).shuffle(rows)
    assert got(merkle.tampered_documents(frame(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, ""), (-3, None, "", 0, "\n\n"), (5, "", "é", 2, "日本\n語"),
            (5, "", "é", 2, "other"), (6, "zß", "x", None, "line\n" * 3000), *[(8, "ab", "en", 1, "same\n")] * 40,
            *[(i, "ab", "en", 1, "t") for i in range(30)]]
    df = frame(spark, rows)
    assert got(merkle.tampered_documents(df)) == brute(rows)
    # columns that bear the names used inside
    more = df.selectExpr("*", "1 AS g", "'x' AS pos", "2 AS digest", "3 AS key", "4 AS now", "5 AS n")
    assert got(merkle.tampered_documents(more)) == brute(rows)


def test_untouched_rows_verify(spark):
    df = frame(spark, [(i, f"s{i % 4}", "en", i, f"t{i}\n") for i in range(50)])
    m = merkle.manifest(df, "doc_id", "source", NAMES).collect()
    assert len(m) == 50 and all(r["verified"] for r in m)
    changed = merkle.manifest(df, "doc_id", "source", NAMES, {"lang": merkle.F.lit("fr")}).collect()
    assert not any(r["verified"] for r in changed)


def test_empty_table(spark):
    assert merkle.tampered_documents(frame(spark, [])).count() == 0
