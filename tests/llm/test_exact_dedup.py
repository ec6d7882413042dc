import hashlib

import pytest

from spanrules.llm import exact_dedup

SCHEMA = "doc_id long, text string, maybe int, keep_id string, sha int, bits int"
ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b " * 5000), (6, "b " * 5000), (7, "c"), (8, "a"),
        (9, "d"), (9, "d"), (None, "e"), (10, "e"), (11, "A"), (12, "c ")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], SCHEMA)


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        same = groups[t or ""]
        keep = max((x for x in same if x is not None), default=None)
        out.append((i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_groups_match_brute_force(spark):
    df = exact_dedup.copy_groups(frame(spark, ROWS))
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert dict(df.dtypes)["group_size"] == "bigint"
    assert sorted(map(tuple, df.collect()), key=repr) == brute(ROWS)


def test_drop_copies_keeps_rows_and_columns(spark):
    docs = frame(spark, ROWS)
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    keep = [(i, t) for (i, t), (_, k, *_r) in zip(ROWS, [(i, max((x for x, u in ROWS if (u or "") == (t or "") and x is not None))) for i, t in ROWS]) if i == k]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted(keep, key=repr)


def test_empty_table(spark):
    docs = frame(spark, [])
    assert exact_dedup.copy_groups(docs).count() == 0
    assert exact_dedup.drop_copies(docs).count() == 0


@pytest.mark.parametrize("bits", [1 << 16])
def test_crowded_filter_gives_the_same_result(spark, monkeypatch, bits):
    monkeypatch.setattr(exact_dedup, "MIN_BITS", bits)
    monkeypatch.setattr(exact_dedup, "MAX_BITS", bits)
    rows = [(i, f"text {i % 4000}") for i in range(6000)]
    got = exact_dedup.copy_groups(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
