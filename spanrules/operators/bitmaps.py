"""Bitmap index of the traces, for rule spaces too wide for a cube.

With many columns nearly every trace has a combination of buckets of its own, so grouping by it saves
nothing. The index keeps, for each block of 32,768 rows and each (column, threshold), the set of rows with
``x >= t`` and the set of those without (bucket ``b`` of a row: the first for thresholds below ``b``, the
second for the others), and per target bucket and binary digit of the row counts (rows may stand for several
traces) the set of rows that have it. A set that is empty is not stored, the others compress in the files.
A task packs the sets of a block from the block's rows, so no entry per (row, column, threshold) is sorted.

A rule is the AND of two sets per condition (``x >= t_lo``, not ``x >= t_hi``), taken block by block; a block
that lacks one of them adds nothing. What is left is ANDed with each target set of the block and counted. The
index is dealt by block, the rules are sent to the tasks in portions of bounded size. A task keeps the sets of
one block and one number per (rule, target bucket), so what is shuffled is the index once per portion and then
those numbers once per task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanrules.session import cut_lineage, ship_by_value

BELOW, FROM, ALL, TARGET = 0, 1, 2, 3  # kinds of sets: x < t, x >= t, every row, rows of a target bucket and digit
BLOCK = 1 << 15
PORTION_KEYS = 200_000      # keys of rules sent at once, about 10 bytes each
RULES_AT_ONCE = 128         # rules whose rows of a block (4 KB each) are ANDed together

ship_by_value(__name__)


def _sets_of(b: np.ndarray, yb: np.ndarray, n: np.ndarray, sizes: Sequence[int]) -> Iterator[tuple[int, int, int, bytes]]:
    """``(kind, c, i, bits)``: the sets of a block's rows that are not empty."""
    def packed(rows: np.ndarray) -> bytes:
        return np.packbits(rows, bitorder="little").tobytes().ljust(BLOCK // 8, b"\0")

    yield ALL, 0, 0, packed(np.ones(len(yb), bool))
    for c, size in enumerate(sizes):
        for i in range(size):
            has = b[:, c] > i
            if has.any():
                yield FROM, c, i, packed(has)
            if not has.all():
                yield BELOW, c, i, packed(~has)
    for y in np.unique(yb).tolist():
        for digit in range(int(n.max()).bit_length()):
            has = (yb == y) & ((n >> digit) & 1 == 1)
            if has.any():
                yield TARGET, y, digit, packed(has)


def _rules_of(rules: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """Numbers of the rules and, by chunks of ``RULES_AT_ONCE`` of them, the codes of the sets that they are the
    AND of, as many for each rule of a chunk."""
    found = []
    for at, rule in zip(rules.column("at").to_pylist(), rules.column("rule").to_pylist()):
        keys = [k for x in rule for k in (_code(FROM, x["c"], x["lo"]), _code(BELOW, x["c"], x["hi"]))]
        found.append((at, keys or [_code(ALL, 0, 0)]))
    found.sort(key=lambda x: len(x[1]))
    chunks = []
    for a in range(0, len(found), RULES_AT_ONCE):
        some = [keys for _, keys in found[a:a + RULES_AT_ONCE]]
        most = len(some[-1])
        chunks.append(np.array([keys + keys[:1] * (most - len(keys)) for keys in some], np.int64))
    return np.array([at for at, _ in found], np.int64), chunks


def _code(kind: int, c: int, i: int) -> int:
    return kind << 56 | c << 28 | i


class BitmapIndex:
    """``table``: ``(block, kind, c, i, bits)``, written; ``targets``: ``(block, yb, digit, bits)``, a part of it."""

    def __init__(self, rows: DataFrame, sizes: Sequence[int]):
        """``rows``: ``b array<int>, yb int, n long`` (cells of a cube, or traces with ``n = 1``)."""
        sizes = [int(x) for x in sizes]
        rows = cut_lineage(rows.select("b", "yb", "n"))
        # (few rows in many partitions would make blocks that are mostly empty)
        rows = rows.coalesce(1 + rows.count() // BLOCK).withColumn("part", F.spark_partition_id())

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, have, block = [], 0, None

            def sets(some: list[pa.RecordBatch]) -> pa.RecordBatch:
                t = pa.Table.from_batches(some).combine_chunks()
                b = pc.fill_null(pc.list_flatten(t.column("b")), 0).to_numpy().reshape(len(t), len(sizes))
                kind, c, i, bits = zip(*_sets_of(b, t.column("yb").to_numpy(), t.column("n").to_numpy(), sizes))
                return pa.record_batch([pa.array([block] * len(kind), pa.int64()), pa.array(kind, pa.int32()),
                                        pa.array(c, pa.int32()), pa.array(i, pa.int32()), pa.array(bits, pa.binary())],
                                       names=["block", "kind", "c", "i", "bits"])

            for batch in batches:
                while batch.num_rows:
                    if block is None:
                        block = batch.column("part")[0].as_py() << 32
                    part = batch.slice(0, BLOCK - have)
                    held.append(part)
                    have += part.num_rows
                    batch = batch.slice(part.num_rows)
                    if have == BLOCK:
                        yield sets(held)
                        held, have, block = [], 0, block + 1
            if held:
                yield sets(held)

        self.table = cut_lineage(rows.mapInArrow(pack, "block long, kind int, c int, i int, bits binary"))
        self.targets = (self.table.where(F.col("kind") == TARGET)
                        .select("block", F.col("c").alias("yb"), F.col("i").alias("digit"), "bits"))

    def counts(self, rules: DataFrame) -> DataFrame:
        """``(rule_id, yb, n)`` of the traces that each rule (``rule_id, rule``, once each) matches; target buckets
        without a match are left out."""
        rules = cut_lineage(rules.select("rule_id", "rule", F.monotonically_increasing_id().alias("at")))
        size = rules.agg(F.sum(2 * F.size("rule") + 1)).first()[0] or 0
        portions = 1 + size // PORTION_KEYS
        found = None
        for k in range(portions):
            some = rules if portions == 1 else rules.where(F.pmod(F.xxhash64("rule_id"), F.lit(portions)) == k)
            hit = self._portion(some.select("at", "rule").toArrow())
            hit = hit if portions == 1 else cut_lineage(hit)
            found = hit if found is None else found.unionByName(hit)
        return rules.join(found, "at").select("rule_id", "yb", "n")

    def _portion(self, rules: pa.Table) -> DataFrame:
        """``(at, yb, n)`` of the rules ``at, rule``."""
        numbers, chunks = _rules_of(rules)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}

            def add(sets: dict[int, bytes], targets: list[tuple[int, int, bytes]]) -> None:
                codes = np.array(sorted(sets), np.int64)
                rows = np.zeros((len(codes) + 1, BLOCK // 64), np.uint64)  # the last one: a set that is empty
                for at, code in enumerate(codes.tolist()):
                    rows[at] = np.frombuffer(sets[code], np.uint64)
                first = 0
                for chunk in chunks:
                    at = np.minimum(np.searchsorted(codes, chunk), len(codes) - 1)
                    at = np.where(codes[at] == chunk, at, len(codes))
                    met = rows[at[:, 0]]
                    for j in range(1, at.shape[1]):
                        met &= rows[at[:, j]]
                    for y, digit, bits in targets:
                        n = np.bitwise_count(met & np.frombuffer(bits, np.uint64)).sum(1, dtype=np.int64) << digit
                        total.setdefault(y, np.zeros(len(numbers), np.int64))[first:first + len(chunk)] += n
                    first += len(chunk)

            block, sets, targets = None, {}, []
            for batch in batches:
                of, kind, c, i = (batch.column(x).to_pylist() for x in ("block", "kind", "c", "i"))
                for x, bits in enumerate(batch.column("bits")):
                    if of[x] != block:
                        if sets:
                            add(sets, targets)
                        block, sets, targets = of[x], {}, []
                    if kind[x] == TARGET:
                        targets.append((c[x], i[x], bits.as_py()))
                    else:
                        sets[_code(kind[x], c[x], i[x])] = bits.as_py()
            if sets:
                add(sets, targets)
            for y, n in total.items():
                some = np.flatnonzero(n)
                yield pa.record_batch([pa.array(numbers[some]), pa.array(np.full(len(some), y, np.int32)),
                                       pa.array(n[some])], names=["at", "yb", "n"])

        # what stands for a set of rows stays where its block is
        dealt = self.table.repartition("block").sortWithinPartitions("block")
        return (dealt.mapInArrow(count, "at long, yb int, n long")
                .groupBy("at", "yb").agg(F.sum("n").alias("n")))
