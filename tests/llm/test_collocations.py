import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from spanrules.llm import collocations

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [w for p in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)) if (w := re.findall(r"[^\x20\x09]+", p))]


def brute(rows, min_count, cover, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    cand = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= min_count}
    out = {}
    for (lang, g), a in cand.items():
        if any(x == lang and len(t) > len(g) and g in (t[:2], t[1:]) and 100 * b >= cover * a for (x, t), b in cand.items()):
            continue
        score, k, l, r = min((10**6 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]])
                             for k in range(1, len(g)))
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s)
                  for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


COLS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def got(df):
    assert tuple(df.columns) == COLS
    return sorted(tuple(r) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string")


def test_matches_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    mine = got(collocations.phrases(docs))
    sql = con.sql(collocations.oracle_sql())
    assert mine == sorted(tuple(r[sql.columns.index(c)] for c in COLS) for r in sql.fetchall())
    assert len(mine) > 500


@pytest.mark.parametrize("seed, words, min_count, cover, top", [(1, 4, 3, 50, 2000), (2, 12, 2, 80, 15), (3, 3, 10, 100, 2000), (4, 30, 2, 1, 9)])
def test_random_texts(spark, seed, words, min_count, cover, top):
    rng = random.Random(seed)
    voc = [f"w{i}" for i in range(words - 2)] + ["É", "Zz"]
    run = " ".join(f"chain{i}" for i in range(40))  # a long unary path
    rows = []
    for i in range(60):
        t = "".join(rng.choice(voc) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "!? "]) for _ in range(rng.randrange(40)))
        rows.append((rng.choice(["en", "fr", None, "und"]), t + (run if i % 5 == 0 else "") + rng.choice(["", " a a a a"])))
    assert got(collocations.phrases(frame(spark, rows).repartition(3), min_count, cover, top)) == brute(rows, min_count, cover, top)


def test_hot_nodes_and_small_slices(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE_BYTES", 300)
    rows = [("en", f"very hot w{i % 37} very hot {'x y z ' * (i % 4)}") for i in range(200)]
    assert got(collocations.phrases(frame(spark, rows).repartition(4), 3)) == brute(rows, 3, 50, 2000)


def test_odd_rows(spark):
    rows = [(None, None), ("en", ""), ("en", " \t\n.,;"), ("en", "one"), ("", "a b a b a b"), ("en", "nb sp nb sp x nb sp"),
            ("en", "A\x0bB\x0cC\rD A"), ("zz", "long " * 20_000), *[("en", "same text, same text here")] * 30]
    df = frame(spark, rows)
    assert got(collocations.phrases(df, 2)) == brute(rows, 2, 50, 2000)
    more = df.selectExpr("*", "1 AS h", "2 AS n", "3 AS word", "4 AS rank")
    assert got(collocations.phrases(more, 2)) == brute(rows, 2, 50, 2000)


def test_empty_table(spark):
    assert collocations.phrases(frame(spark, [])).count() == 0


def test_words_of_neighbouring_texts_stay_apart():
    words, text, joined = collocations.words_of(pa.array(["ab c", "d", None, "", "E.f g"]))
    assert words.to_pylist() == [b"ab", b"c", b"d", b"e", b"f", b"g"]
    assert text.tolist() == [0, 0, 1, 4, 4, 4] and joined.tolist() == [False, True, False, False, False, True]
    none, _, _ = collocations.words_of(pa.array([], pa.string()))
    assert len(none) == 0


def test_filter_of_frequent_words(spark):
    rows = [(int(h), "en", "w", 20 if i % 3 else 2) for i, h in enumerate(np.random.default_rng(1).integers(-2**63, 2**63 - 1, 5000))]
    filt = collocations.frequent_words(spark.createDataFrame(rows, "h long, lang string, word string, n long"), 10)
    inside = filt.has(np.array([r[0] for r in rows], np.int64))
    assert all(inside[i] for i, r in enumerate(rows) if r[3] == 20)
    assert sum(inside[i] for i, r in enumerate(rows) if r[3] == 2) < 100


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MAX_FILTER", 1 << 15)
    rows = [("en", " ".join(f"w{i * j % 97}" for j in range(60))) for i in range(50)]
    assert got(collocations.phrases(frame(spark, rows), 3)) == brute(rows, 3, 50, 2000)


def test_scores_pass_64_bits(spark):
    row = spark.createDataFrame([(3_000_000_000, 4_000_000_000, 3_500_000_001)], "a long, x long, y long")
    got = row.select(collocations._score("a", "x", "y")).first()[0]
    assert got == 10**6 * 3_000_000_000**2 // (4_000_000_000 * 3_500_000_001)


def test_another_seed_where_words_share_a_hash(spark, monkeypatch):
    real = collocations._hashes

    def weak(langs, words, seed):
        return real(langs, words, seed) % 3 if seed == 0 else real(langs, words, seed)

    monkeypatch.setattr(collocations, "_hashes", weak)
    rows = [("en", "a b c d e f")] * 4
    assert got(collocations.phrases(frame(spark, rows), 2)) == brute(rows, 2, 50, 2000)
