"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by any path Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """Column names that clash with none of ``taken`` (compared without case)."""
    used = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def whole_text(col: str | Column = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def text_bytes(column) -> tuple["np.ndarray", "np.ndarray"]:
    """UTF-8 bytes of an Arrow string column, one after the other, and the n + 1 offsets of the
    texts in them. A null is an empty text. Arrow's buffers are read without a copy per text."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def slices(batch, limit: int = 4 << 20, column: str = "text", rows: int = 4096):
    """Parts of an Arrow batch of about ``limit`` bytes of text and at most ``rows`` rows each (one
    row at least), so that the arrays made of a part stay small whatever the lengths of the texts."""
    import numpy as np

    _, at = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        stop = min(stop, start + rows, batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop
    give_back()


def give_back() -> None:
    """Memory that this process has freed goes back to the system: a Python worker lives on between tasks, and would
    keep what the largest of them took."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


BATCH_ROWS = 512  # texts that a task hands to Python at once


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Jobs that run within hand at most ``rows`` rows to Python at once. A batch of texts takes a multiple of
    its size in a task's buffers on either side, so this bounds the memory of an executor beside its heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) < rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


BROADCAST_BYTES = 16 << 20
FILTER_WORDS = BROADCAST_BYTES // 32


def broadcast_if_small(written: DataFrame, row_bytes: int) -> DataFrame:
    """``written`` (a table read back, so that counting it is cheap) with a broadcast hint if its
    rows of about ``row_bytes`` bytes fit ``BROADCAST_BYTES``; else the join shuffles both sides."""
    return F.broadcast(written) if written.count() * row_bytes <= BROADCAST_BYTES else written


def likely(rows: DataFrame, wanted: DataFrame, col: str) -> DataFrame:
    """``rows`` without most of those whose ``col`` is not in ``wanted``: hashes of the wanted ones are bits in
    words of 64, of which ``FILTER_WORDS`` at most are broadcast."""
    word, bit = f"pmod(shiftright(xxhash64({col}), 6), {FILTER_WORDS})", f"cast(xxhash64({col}) & 63 as int)"
    words = wanted.groupBy(F.expr(word).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias("bits"))
    return (rows.withColumn("word", F.expr(word)).join(F.broadcast(words), "word")
            .where(f"bit_get(bits, {bit}) = 1").drop("word", "bits"))


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id is in the one column of ``ids`` (a written table)."""
    (gone,) = fresh(docs.columns, "gone")
    small = broadcast_if_small(ids, 24).toDF(gone)
    return docs.join(small, F.col(id_col).eqNullSafe(F.col(gone)), "left_anti")
