"""Driver contract, and a few queries against their DuckDB oracle on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_mod
from conftest import SF_SMALL


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert "traceId" in df.columns and "checkout_avg_dur" in df.columns
    assert df.count() > 0


def test_oracle_keys_are_queries():
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())
    assert len(entry_mod.queries()) >= 30


def _rows(rows):
    out = []
    for r in rows:
        out.append(tuple(round(v, 6) if isinstance(v, float) else v for v in r))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", ["avg_trace_matrix", "rule_metrics", "ruleset_metrics",
                                  "bnb_best_rule", "bandwidth"])
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    df = entry_mod.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = _rows(tuple(r[c] for c in cols) for r in df.collect())
    rel = con.sql(entry_mod.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    want = _rows(tuple(dict(zip(rel.columns, r))[c] for c in cols) for r in rel.fetchall())
    assert got == want
