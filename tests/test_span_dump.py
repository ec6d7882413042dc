"""The dump source: what is pushed, what is read, odd files, round trips."""

import json

import pytest
from pyspark.sql import functions as F

from spanrules.sources import span_dump
from spanrules.sources.spans import root_experiments, spans_by_interval

DAY = 86_400 * 1_000_000


def spans_frame(spark, n=200):
    rows = [(str(i), f"svc{i % 3}", i * 10, f"s{i}", "SERVER" if i % 2 else "CLIENT", i * DAY if i % 17 else None, f"p{i}" if i % 5 else None,
             "exp" if i % 5 == 0 else None) for i in range(n)]
    return spark.createDataFrame(rows, "traceId string, name string, duration long, id string, kind string, timestamp long, parentId string, experiment string")


@pytest.fixture()
def dump(spark, tmp_path):
    df = spans_frame(spark)
    span_dump.write_dump(df.repartition(3), str(tmp_path / "dump"))
    return df, str(tmp_path / "dump")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_round_trip(spark, dump):
    df, path = dump
    back = span_dump.read_dump(spark, path)
    assert back.columns == df.columns and rows(back) == rows(df)
    assert rows(span_dump.read_dump(spark, path, split_bytes=100)) == rows(df)


def executed(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    print(plan)
    return [x.strip().split(" ", 1)[-1].split(" ")[0] for x in plan.replace("+- ", "").splitlines()]


def test_filters_are_pushed_and_files_pruned(spark, dump):
    df, path = dump
    wanted = [F.col("timestamp").between(40 * DAY, 75 * DAY), F.col("kind") == "SERVER"]
    got = span_dump.read_dump(spark, path).where(wanted[0] & wanted[1])
    assert rows(got) == rows(df.where(wanted[0] & wanted[1])) != []
    assert "Filter" not in executed(got)  # nothing left for Spark to test
    assert got.rdd.getNumPartitions() < span_dump.read_dump(spark, path).rdd.getNumPartitions()
    # a filter that the source does not know stays with Spark
    odd = span_dump.read_dump(spark, path).where((F.col("duration") % 3 == 0) & F.col("parentId").isNull())
    assert rows(odd) == rows(df.where((F.col("duration") % 3 == 0) & F.col("parentId").isNull()))
    assert "Filter" in executed(odd)


@pytest.mark.parametrize("condition", [
    "kind = 'SERVER' AND duration > 50", "duration <= 100 AND timestamp IS NULL", "name IN ('svc1', 'svc2') AND duration >= 1900",
    "experiment <=> NULL AND kind <=> 'CLIENT'", "timestamp < 3000000000000 AND parentId IS NOT NULL", "timestamp = 864000000000",
    "name > 'svc1'", "kind = 'SERVER' OR duration < 20", "traceId = '7'", "NOT (kind = 'CLIENT')", "duration IN (10, 20, NULL)"])
def test_every_filter_gives_what_spark_gives(spark, dump, condition):
    df, path = dump
    assert rows(span_dump.read_dump(spark, path).where(condition)) == rows(df.where(condition))


def test_interval_scan_and_roots(spark, dump):
    df, path = dump
    raw = span_dump.read_dump(spark, path)
    assert rows(spans_by_interval(raw, 10 * DAY, 60 * DAY)) == rows(spans_by_interval(df, 10 * DAY, 60 * DAY))
    assert rows(root_experiments(raw, None, 90 * DAY)) == rows(root_experiments(df, None, 90 * DAY))


def test_foreign_files(spark, tmp_path):
    hit = {"_index": "zipkin", "_source": {"traceId": "a", "name": "x", "duration": 5, "timestamp": 3 * DAY, "kind": "SERVER", "id": 7}}
    (tmp_path / "zipkin-span-1970-01-04.json").write_text(json.dumps(hit) + "\n\n" + json.dumps(hit["_source"]))
    (tmp_path / "more.json").write_text(json.dumps({"traceId": "b", "timestamp": 9 * DAY, "name": "é\n"}) + "\n")
    (tmp_path / "_other").write_text("not a dump")
    raw = span_dump.read_dump(spark, str(tmp_path))
    assert sorted((r["traceId"], r["duration"], r["id"], r["name"]) for r in raw.collect()) == [("a", 5, "7", "x"), ("a", 5, "7", "x"), ("b", None, None, "é\n")]
    assert [r["traceId"] for r in raw.where(F.col("timestamp") > 5 * DAY).collect()] == ["b"]
    # a name that lies is only believed if it is to be
    (tmp_path / "spans-1999-01.json").write_text(json.dumps({"traceId": "c", "timestamp": 4 * DAY}) + "\n")
    late = F.col("timestamp").between(4 * DAY, 5 * DAY)
    assert span_dump.read_dump(spark, str(tmp_path)).where(late).count() == 0
    assert span_dump.read_dump(spark, str(tmp_path), periods=False).where(late).count() == 1


def test_empty_dump_and_bad_lines(spark, tmp_path):
    span_dump.write_dump(spans_frame(spark).limit(0), str(tmp_path / "none"))
    assert span_dump.read_dump(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "spans.json").write_text('{"traceId": "a"}\n[1, 2]\n')
    with pytest.raises(Exception, match="spans.json"):
        span_dump.read_dump(spark, str(tmp_path / "bad")).collect()


def test_a_file_that_no_manifest_names_is_not_read(spark, dump):
    df, path = dump
    with open(f"{path}/spans-1970-01-left.jsonl", "w") as f:
        f.write('{"traceId": "left over"}\n')
    assert span_dump.read_dump(spark, path).count() == df.count()


@pytest.mark.parametrize("name, want", [("spans-1996-03.jsonl", (820454400 * 10**6 + 60 * DAY, 820454400 * 10**6 + 91 * DAY)), ("x-1970-01-02-y", (DAY, 2 * DAY)),
                                        ("x-1970-12", (334 * DAY, 365 * DAY)), ("x-1970-13", None), ("11970-01", None), ("plain", None)])
def test_periods(name, want):
    assert span_dump.period(name) == want


def test_plain_spans_are_parsed_and_written_as_columns():
    import pyarrow as pa

    plain = b'{"traceId": "a", "duration": 5}\n{"traceId": "b", "more": [1]}\n'
    got = span_dump._columns(plain).to_pylist()
    assert [(r["traceId"], r["duration"], r["name"]) for r in got] == [("a", 5, None), ("b", None, None)]
    for odd in (b'{"traceId": "a"}\n\n{"traceId": "b"}\n', b'{"_source": {"traceId": "a"}}\n', b'{"id": 7}\n', b'{"duration": 1.5}\n',
                b'{"id": "\\u00e9"}\n', b'[1]\n', b'{"id": "a"}{"id": "b"}\n', b'{"id": "a"\n'):
        assert span_dump._columns(odd) is None
    row = {"traceId": 'q"\\', "name": "é\n", "duration": -3, "id": None, "kind": "", "timestamp": 0, "parentId": "p", "experiment": None}
    lines = span_dump._lines(span_dump._batch([row, dict.fromkeys(row)])).to_pylist()
    assert lines == [json.dumps({k: v for k, v in row.items() if v is not None}) + "\n", "{}\n"]


@pytest.mark.parametrize("split", [1, 7, 30, 64, 1000])
@pytest.mark.parametrize("block", [5, 40, 1 << 20])
def test_each_line_belongs_to_one_piece(tmp_path, monkeypatch, split, block):
    monkeypatch.setattr(span_dump, "BLOCK_BYTES", block)
    text = b"".join(b'{"id": "%s"}\n' % (b"x" * i) for i in range(20)) + b'\n{"id": "last"}'
    path = tmp_path / "spans.json"
    path.write_bytes(text)
    got = b"".join(b for at in range(0, len(text), split) for b, _ in span_dump.blocks_of(str(path), at, min(at + split, len(text))))
    assert got == text
