"""Spans -> trace matrices, on hand-made spans with the edge cases of the source model."""

import datetime as dt

import pytest

from spanrules.operators import reshape
from spanrules.sources.spans import root_experiments, spans_by_interval, to_micros

SCHEMA = ("traceId string, name string, duration long, id string, kind string, timestamp long, "
          "parentId string, experiment string")


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        # trace t1: root front (1 client call to b), b serves it; dotted endpoint name
        ("t1", "front", 10_000, "r1", "SERVER", 100, None, "exp1"),
        ("t1", "b.svc", 7_000, "c1", "CLIENT", 101, "r1", None),
        ("t1", "b.svc", 6_000, "s1", "SERVER", 102, "c1", None),
        # trace t2: parallel calls make the root's self time negative
        ("t2", "front", 4_000, "r2", "SERVER", 200, None, "exp2"),
        ("t2", "b.svc", 3_000, "c2a", "CLIENT", 201, "r2", None),
        ("t2", "b.svc", 3_000, "c2b", "CLIENT", 202, "r2", None),
        ("t2", "b.svc", 2_500, "s2", "SERVER", 203, "c2a", None),
        # trace t3: two roots -> two matrix rows
        ("t3", "front", 1_000, "r3", "SERVER", 300, None, "expA"),
        ("t3", "front", 3_000, "r3b", "SERVER", 301, None, "expB"),
        ("t3", "b.svc", 500, "s3", "SERVER", 302, "x", None),
        # trace t4: never reaches b.svc -> dropped by the complete-case filter
        ("t4", "front", 9_000, "r4", "SERVER", 400, None, "exp4"),
        # a CLIENT span without parent and an out-of-interval span
        ("t1", "front", 1, "cx", "CLIENT", 103, None, None),
        ("t1", "front", 99_999, "late", "SERVER", 10**12, None, "late"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_interval_inclusive(raw):
    got = spans_by_interval(raw, 100, 302).collect()
    assert len(got) == 11
    assert {r.timestamp for r in got} >= {100, 302}
    assert spans_by_interval(raw, 101, 301).count() == 9


def test_to_micros():
    assert to_micros(dt.datetime(1970, 1, 1, 0, 0, 1)) == 1_000_000
    assert to_micros(dt.datetime(2000, 1, 1)) == 946_684_800_000_000


def test_root_experiments(raw):
    got = sorted(tuple(r) for r in root_experiments(raw, 0, 10**9).collect())
    assert got == [("t1", "exp1"), ("t2", "exp2"), ("t3", "expA"), ("t3", "expB"), ("t4", "exp4")]


def test_self_duration_negative_and_fill(raw):
    s = {r.id: r for r in reshape.self_duration(spans_by_interval(raw, 0, 10**9)).collect()}
    assert s["r1"].clients_duration == 7_000 and s["r1"].self_duration == 3_000
    assert s["r2"].self_duration == 4_000 - 6_000
    assert s["s1"].clients_duration == 0 and s["s1"].self_duration == 6_000


def test_avg_trace_matrix(raw):
    m = reshape.avg_trace_matrix(raw, 0, 10**9)
    assert set(m.columns) == {"traceId", "b.svc_avg_self_dur", "b.svc_avg_dur", "front_avg_self_dur",
                              "front_avg_dur", "experiment"}
    rows = sorted((r["traceId"], r["experiment"], r["front_avg_self_dur"], r["front_avg_dur"],
                   r["b.svc_avg_dur"]) for r in m.collect())
    # t3 averages its two root spans (2 ms) and keeps one row per root
    assert rows == [("t1", "exp1", 3.0, 10.0, 6.0), ("t2", "exp2", -2.0, 4.0, 3.0),
                    ("t3", "expA", 2.0, 2.0, 1.0), ("t3", "expB", 2.0, 2.0, 1.0)]


def test_sum_trace_matrix(raw):
    m = reshape.sum_trace_matrix(raw, 0, 10**9)
    rows = sorted((r["traceId"], r["front"], r["b.svc"]) for r in m.collect())
    assert rows == [("t1", 10.0, 6.0), ("t2", 4.0, 3.0), ("t3", 4.0, 1.0), ("t3", 4.0, 1.0)]


def test_rounding_half_away_from_zero(spark):
    from pyspark.sql import functions as F

    from spanrules.functions.columns import micros_to_millis
    df = spark.createDataFrame([(1500,), (2500,), (-1500,), (1499,)], "x long")
    got = [r[0] for r in df.select(micros_to_millis(F.col("x"))).collect()]
    assert got == [2.0, 3.0, -2.0, 1.0]


def test_timestamp_micros_ignores_session_zone(spark):
    from pyspark.sql import functions as F

    from spanrules.sources.spans import timestamp_micros
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([(dt.datetime(1997, 1, 15),)], "ts timestamp_ntz")
        assert df.select(timestamp_micros(F.col("ts"))).collect()[0][0] == 853_286_400_000_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_self_duration_by_trace_option(spark):
    rows = [("a", "svc", 10, "s1", "SERVER", 1, None, None),
            ("a", "svc", 4, "c1", "CLIENT", 2, "s1", None),
            ("b", "svc", 20, "s1", "SERVER", 3, None, None)]   # same span id in another trace
    raw = spark.createDataFrame(rows, SCHEMA)
    spans = spans_by_interval(raw, 0, 10)
    plain = {r.traceId: r.self_duration for r in reshape.self_duration(spans).collect()}
    keyed = {r.traceId: r.self_duration for r in reshape.self_duration(spans, by_trace=True).collect()}
    assert plain == {"a": 6, "b": 16}      # id-only join, as the source model
    assert keyed == {"a": 6, "b": 20}


def test_datetime_bounds(raw):
    lo = dt.datetime(1970, 1, 1)
    hi = dt.datetime(1970, 1, 1, 0, 0, 0, 302)
    assert spans_by_interval(raw, lo, hi).count() == 11   # same spans as [100, 302] us


def test_read_spans_with_format_and_options(spark, tmp_path):
    from spanrules.sources.spans import read_spans, spans_by_interval

    path = str(tmp_path / "spans.csv")
    with open(path, "w") as f:
        f.write("traceId;name;duration;id;kind;timestamp;parentId;experiment\n"
                "t1;api;10;a;SERVER;100;;x\nt1;db;4;b;CLIENT;200;a;\nt2;api;7;c;SERVER;300;;y\n")
    raw = read_spans(spark, path, "csv", {"header": "true", "sep": ";", "inferSchema": "true"})
    assert raw.count() == 3
    assert {r["id"] for r in spans_by_interval(raw, 100, 200).collect()} == {"a", "b"}
    assert {r["id"] for r in spans_by_interval(raw, None, 250).collect()} == {"a", "b"}
    assert {r["id"] for r in spans_by_interval(raw, 101, None).collect()} == {"b", "c"}
    assert read_spans(spark, fmt="csv", options={"path": path, "header": "true", "sep": ";"}).count() == 3
