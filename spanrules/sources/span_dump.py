"""Dumps of a tracing index as a Spark source and sink: JSON lines in one file per period, with pushdown.

A dump is a folder of JSON-lines files, a span (or a search hit with the span in ``_source``) per line, named after
the day or month of the spans' start as a tracing index is (``spans-1996-03.jsonl``, ``zipkin-span-2019-03-01.json``).

Reading, through :func:`read_dump`:

* filters on any span field that compare it with a value (``=``, ``<``, ``in``, null or not) are taken over by the
  source, so Spark evaluates nothing again;
* a filter on the start time leaves out the files of other periods before any is opened (files whose name
  has no date are always read; ``periods=False`` trusts no name);
* files are cut into byte ranges, one Spark partition each, and parsed block by block as Arrow columns; blocks
  that hold anything but one plain span per line are read line by line.

Writing, through :func:`write_dump`, deals spans by month and writes one file per month and task. A file counts once
the manifest that the driver writes at the end names it, so a task that runs twice leaves nothing that is read.

Defined cases: a field that a line lacks is null; blank lines are skipped; a line that is no JSON object is an
error that names its file; spans without a start time go into files without a date; an empty dump has no rows.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter,
                                    GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan,
                                    LessThanOrEqual, WriterCommitMessage)

from spanrules.session import ship_by_value

FORMAT = "spandump"
FIELDS = {"traceId": pa.string(), "name": pa.string(), "duration": pa.int64(), "id": pa.string(), "kind": pa.string(),
          "timestamp": pa.int64(), "parentId": pa.string(), "experiment": pa.string()}
SCHEMA = ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in FIELDS.items())
MANIFEST = "_files.json"
SPLIT_BYTES = 64 << 20
BLOCK_BYTES = 1 << 20
BATCH_ROWS = 8192
NO_MONTH = np.iinfo(np.int64).min

ship_by_value(__name__)


def file_system(path: str):
    """File system and path in it: a shared folder, or any that pyarrow reaches."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if "://" in path else (fs.LocalFileSystem(), path)


def _micros(day: dt.date) -> int:
    return (day - dt.date(1970, 1, 1)).days * 86_400 * 1_000_000


def period(name: str) -> tuple[int, int] | None:
    """Start and end (exclusive) of the day or month that a file is named after, in microseconds."""
    m = re.search(r"(?<!\d)(\d{4})-(\d{2})(?:-(\d{2}))?(?!\d)", name)
    if not m:
        return None
    try:
        first = dt.date(int(m[1]), int(m[2]), int(m[3] or 1))
    except ValueError:
        return None
    after = first + dt.timedelta(days=1) if m[3] else (first.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
    return _micros(first), _micros(after)


@dataclass
class Piece(InputPartition):
    """A byte range of a file: the lines that start in it."""

    path: str
    start: int
    end: int

    def __post_init__(self):
        self.value = (self.path, self.start, self.end)


def _test(f: Filter):
    """The condition of a filter on one span, or None if this source leaves it to Spark."""
    if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in FIELDS:
        return None
    c, v = f.attribute[0], getattr(f, "value", None)
    known = {
        EqualTo: lambda s: s[c] is not None and v is not None and s[c] == v,
        EqualNullSafe: lambda s: s[c] == v,
        GreaterThan: lambda s: s[c] is not None and s[c] > v,
        GreaterThanOrEqual: lambda s: s[c] is not None and s[c] >= v,
        LessThan: lambda s: s[c] is not None and s[c] < v,
        LessThanOrEqual: lambda s: s[c] is not None and s[c] <= v,
        In: lambda s: s[c] is not None and s[c] in v,
        IsNull: lambda s: s[c] is None,
        IsNotNull: lambda s: s[c] is not None,
    }
    if isinstance(v, str) and type(f) in (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual):
        return None  # Spark orders strings by their bytes
    return known.get(type(f))


class SpanDumpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.by_name = options.get("periods", "true").lower() != "false"
        self.pushed: list[Filter] = []

    def pushFilters(self, filters):
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.pushed.append(f)

    def _wanted(self) -> tuple[float, float]:
        """The start times that the filters leave."""
        lo, hi = float("-inf"), float("inf")
        for f in self.pushed:
            if f.attribute == ("timestamp",):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    lo = max(lo, f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    hi = min(hi, f.value)
        return lo, hi

    def partitions(self) -> list[Piece]:
        from pyarrow import fs

        system, inner = file_system(self.path)
        found = {f.base_name: f.size for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File}
        if MANIFEST in found:
            with system.open_input_file(f"{inner}/{MANIFEST}") as f:
                found = {name: found[name] for name in json.loads(f.read())}
        lo, hi = self._wanted()
        out = []
        for name, size in sorted(found.items()):
            of = period(name) if self.by_name else None
            if name.startswith(("_", ".")) or (of and (of[1] <= lo or of[0] > hi)):
                continue
            out += [Piece(f"{self.path.rstrip('/')}/{name}", at, min(at + self.split, size)) for at in range(0, size, self.split)]
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        tests = [_test(f) for f in self.pushed]
        # (a dump without files has no piece)
        for block, at in blocks_of(partition.path, partition.start, partition.end) if partition else ():
            spans = _columns(block)
            if spans is not None:
                for f in self.pushed:
                    spans = spans.filter(_mask(f, spans))
                yield from spans.to_batches(max_chunksize=BATCH_ROWS)
                continue
            rows: list[dict] = []
            for span in _spans(partition.path, block, at):
                if all(t(span) for t in tests):
                    rows.append(span)
                    if len(rows) == BATCH_ROWS:
                        yield _batch(rows)
                        rows = []
            yield _batch(rows)


def _mask(f: Filter, spans: pa.Table):
    """The condition of a filter that :func:`_test` knows, on columns; null counts as false."""
    c, v = spans.column(f.attribute[0]), getattr(f, "value", None)
    if isinstance(f, IsNull) or (isinstance(f, EqualNullSafe) and v is None):
        return pc.is_null(c)
    if isinstance(f, IsNotNull):
        return pc.is_valid(c)
    if isinstance(f, In):
        return pc.is_in(c, value_set=pa.array([x for x in v if x is not None], c.type))
    compare = {EqualTo: pc.equal, EqualNullSafe: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal,
               LessThan: pc.less, LessThanOrEqual: pc.less_equal}[type(f)]
    return pc.fill_null(compare(c, pa.scalar(v, c.type)), False)


def _columns(block: bytes) -> pa.Table | None:
    """The spans of whole lines, or None if they are not surely one plain object with fields of our types each."""
    from pyarrow import json as columns

    lines = block.count(b"\n") + (not block.endswith(b"\n"))
    ends = block.count(b"}\n{")
    if ends != lines - 1 or not block.startswith(b"{") or not block.endswith((b"}\n", b"}")):
        return None
    if b"_source" in block or b"\\u" in block or not block.isascii():
        return None
    try:
        found = columns.read_json(pa.BufferReader(block), columns.ReadOptions(use_threads=False, block_size=len(block) + 1),
                                  columns.ParseOptions(pa.schema(list(FIELDS.items())), unexpected_field_behavior="ignore"))
    except pa.ArrowInvalid:
        return None
    return found.select(list(FIELDS)) if found.num_rows == lines else None


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[n] for r in rows], t) for n, t in FIELDS.items()], names=list(FIELDS))


def blocks_of(path: str, start: int, end: int) -> Iterator[tuple[bytes, int]]:
    """The lines that start in a byte range of a file, in blocks of whole lines, and where each block starts."""
    system, inner = file_system(path)
    with system.open_input_file(inner) as raw:
        at = max(start - 1, 0)
        raw.seek(at)
        skip, rest = start > 0, b""  # the line that the byte before belongs to is another piece's
        while True:
            more = raw.read(BLOCK_BYTES)
            cut = more.rfind(b"\n") + 1
            if more and not cut:
                rest += more
                continue
            block, rest = (rest + more[:cut], more[cut:]) if more else (rest, b"")
            if skip and block:
                first = block.find(b"\n") + 1 or len(block)
                block, at, skip = block[first:], at + first, False
            if at + len(block) > end > at:  # up to the end of the line that the last byte belongs to
                last = block.find(b"\n", end - 1 - at) + 1
                block = block[:last or len(block)]
            if at >= end:
                return
            if block:
                yield block, at
            at += len(block)
            if not more:
                return


def _spans(path: str, block: bytes, at: int) -> Iterator[dict]:
    """The spans of a block of lines, one by one."""
    for line in block.split(b"\n"):
        at += len(line) + 1
        if line.strip():
            try:
                hit = json.loads(line)
                span = hit.get("_source", hit)
                yield {n: _as(t, span.get(n)) for n, t in FIELDS.items()}
            except (ValueError, AttributeError, TypeError) as e:
                raise ValueError(f"{path}: a line that ends at byte {at} is no span: {e}") from None


def _as(kind: pa.DataType, value):
    if value is None:
        return None
    return int(value) if kind == pa.int64() else value if isinstance(value, str) else json.dumps(value)


def _lines(spans: pa.RecordBatch) -> pa.Array:
    """The JSON line of each span, without its nulls."""
    parts = []
    for name in (n for n in spans.schema.names if n in FIELDS):
        column = spans.column(name)
        if FIELDS[name] == pa.string():
            if pc.any(pc.match_substring_regex(column, r'[^ !#-\[\]-~]')).as_py():  # quotes, controls and other letters
                text = pa.array([None if x is None else json.dumps(x) for x in column.to_pylist()], pa.string())
            else:
                text = pc.binary_join_element_wise('"', column.cast(pa.string()), '"', "")
        else:
            text = column.cast(pa.string())
        parts.append(pc.fill_null(pc.binary_join_element_wise(f', "{name}": ', text, ""), ""))
    # (a join that skips nulls loses the rows that have nothing else)
    return pc.binary_join_element_wise("{", pc.binary_replace_slice(pc.binary_join_element_wise(*parts, ""), 0, 2, ""), "}\n", "")


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class SpanDumpWriter(DataSourceArrowWriter):
    """Writes the batches of a task; the rows of a task come sorted by month, so one file is open at a time."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, inner = file_system(self.path)
        names, out, month = [], None, None
        for batch in iterator:
            starts = batch.column("timestamp")
            months = np.where(starts.is_null(), NO_MONTH,
                              pc.fill_null(starts, 0).to_numpy().astype("datetime64[us]").astype("datetime64[M]").astype(np.int64))
            lines = _lines(batch).cast(pa.large_string())
            edges = [0, *(np.flatnonzero(np.diff(months)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if out is None or months[a] != month:
                    if out is not None:
                        out.close()
                    month = months[a]
                    named = "undated" if month == NO_MONTH else str(np.datetime64(int(month), "M"))
                    names.append(f"spans-{named}-{uuid.uuid4().hex}.jsonl")
                    out = system.open_output_stream(f"{inner}/{names[-1]}")
                _, offsets, data = lines.buffers()
                at = np.frombuffer(offsets, np.int64)
                out.write(data.slice(int(at[lines.offset + a]), int(at[lines.offset + b] - at[lines.offset + a])))
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages) -> None:
        system, inner = file_system(self.path)
        with system.open_output_stream(f"{inner}/{MANIFEST}") as f:
            f.write(json.dumps(sorted(n for m in messages if m for n in m.files)).encode())

    def abort(self, messages) -> None:
        """Files without a manifest entry are never read."""


class SpanDump(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SpanDumpReader:
        return SpanDumpReader(self.options)

    def writer(self, schema, overwrite: bool) -> SpanDumpWriter:
        return SpanDumpWriter(self.options)


def _register(spark: SparkSession) -> None:
    spark.dataSource.register(SpanDump)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_dump(spark: SparkSession, path: str, periods: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The span table of a dump."""
    _register(spark)
    return (spark.read.format(FORMAT).option("splitBytes", split_bytes).option("periods", str(periods)).load(path))


def write_dump(spans: DataFrame, path: str) -> None:
    """Writes a span table as a dump. Spans are dealt by ranges of their start time, so a month of any size
    spreads over several files and a task writes few of them."""
    _register(spans.sparkSession)
    system, inner = file_system(path)
    system.create_dir(inner, recursive=True)
    rows = spans.select(*[F.col(n).cast("long" if t == pa.int64() else "string").alias(n) for n, t in FIELDS.items()])
    dealt = rows.repartitionByRange("timestamp", "traceId", "id").sortWithinPartitions("timestamp")
    dealt.write.format(FORMAT).mode("append").save(path)
