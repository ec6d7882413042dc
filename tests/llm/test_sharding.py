import duckdb
import pytest

from spanrules.llm import sharding

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("limit", [32 << 20, 150_000, 9_000])
def test_matches_sql(spark, limit):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(sharding.oracle_sql(limit))
    got = sharding.shard_of(spark.read.parquet(f"{SF}/documents.parquet"), limit)
    at = [want.columns.index(c) for c in sorted(got.columns)]
    assert rows(got) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


def frame(spark, data):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in data], "doc_id long, text string, bits int, shard string")


def test_cases(spark):
    data = [(1, None), (None, "n" * 50), (2, ""), (3, "x" * 5000), *[(4, "same" * 10)] * 60,
            *[(100 + i, "copy" * 10) for i in range(200)]]
    docs = frame(spark, data)
    out = sharding.assign(docs, 1000, shard="place")
    assert out.columns == [*docs.columns, "place"]
    got = out.collect()
    assert len(got) == len(data) and all(r["place"] is not None for r in got)
    sizes = {}
    for r in got:
        sizes.setdefault(r["place"]["id"], []).append(len(r["text"] or ""))
    for r in got:
        p = r["place"]
        assert p["bytes"] == sum(sizes[p["id"]]) and p["rows"] == len(sizes[p["id"]]) and p["depth"] == len(p["id"])
        assert p["oversize"] == (p["bytes"] > 1000)
    # only what cannot be split is over the limit: the long row, and the rows that are all the same
    assert {r["doc_id"] for r in got if r["place"]["oversize"]} == {3, 4}
    ids = sorted(sizes)
    assert not any(b.startswith(a) for a, b in zip(ids, ids[1:]))  # no shard holds another


def test_empty_table(spark):
    assert sharding.shard_of(frame(spark, [])).count() == 0


def test_write_shards(spark, tmp_path):
    data = [(i, "text " * 20) for i in range(50)]
    sharding.write_shards(frame(spark, data), str(tmp_path / "out"), 1500)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["doc_id"] for r in back.collect()) == list(range(50))
    assert max(n for (n,) in back.groupBy("shard_id").count().select("count").collect()) * 100 <= 1500
