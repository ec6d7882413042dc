"""Bucket cube: the traces reduced to what every rule metric needs.

Conditions are aligned with thresholds, so a trace is fully described, for rule purposes, by its
bucket per rule column, ``b(x) = number of thresholds <= x`` (0 for NULL/NaN), and its target
bucket ``yb(y) = number of split points < y``. Then

* ``t_lo <= x < t_hi``  <=>  ``lo < b(x) <= hi``  (threshold indexes, 0-based);
* ``s_j < y <= s_i``    <=>  ``j < yb(y) <= i``.

:func:`bucket_cube` groups the traces by ``(b, yb)`` and keeps ``n, s1 = sum(y - s_0), s2 = sum((y - s_0)^2)``
(one shuffle, partial aggregation on the map side). Its size is bounded by the product of the
bucket counts, independent of the number of traces. :func:`marginals` projects it onto the column
sets that candidate rules use; scoring looks up sums over those projections, so no candidate ever
rescans the traces.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanrules.functions.columns import clean_double, qcol


@dataclass(frozen=True)
class Space:
    """Driver-side description of the rule space (small: one list per column)."""

    cols: tuple[str, ...]
    thresholds: dict[str, list[float]]
    target: str
    splits: tuple[float, ...]          # sorted split points of the target
    meta: dict = field(default_factory=dict, compare=False)

    def nth(self, pos: int) -> list[float]:
        return self.thresholds[self.cols[pos]]

    @property
    def n_buckets(self) -> list[int]:
        return [len(self.thresholds[c]) for c in self.cols]


def ladder(x: Column, cuts: Sequence[float], strict: bool = False) -> Column:
    """Number of cut values ``<= x`` (``< x`` when ``strict``); 0 for NULL. Sorted cuts."""
    cuts = sorted(cuts)
    expr = F.lit(0)
    for k, t in enumerate(cuts):
        hit = (x > F.lit(float(t))) if strict else (x >= F.lit(float(t)))
        expr = F.when(hit, F.lit(k + 1)).otherwise(expr)
    return expr.cast("int")


def bucket_columns(space: Space) -> list[Column]:
    return [ladder(clean_double(qcol(c)), space.thresholds[c]) for c in space.cols]


def bucket_rows(traces: DataFrame, space: Space) -> DataFrame:
    """``(b array<int>, yb int, n long, s1 double, s2 double)`` of every trace (``n = 1``); traces with no
    target dropped.

    ``s1, s2`` are the target's distance from the first split point and its square: about a centre
    among the data their sums stay as small as the deviations are."""
    y = clean_double(qcol(space.target))
    off = F.col("y") - F.lit(float(space.splits[0]) if space.splits else 0.0)
    return (traces.select(F.array(*bucket_columns(space)).alias("b"),
                          ladder(y, space.splits, strict=True).alias("yb"), y.alias("y"))
                  .filter(F.col("y").isNotNull())
                  .select("b", "yb", F.lit(1).cast("long").alias("n"), off.alias("s1"), (off * off).alias("s2")))


def bucket_cube(traces: DataFrame, space: Space) -> DataFrame:
    """The rows of :func:`bucket_rows` summed by ``(b, yb)``."""
    return (bucket_rows(traces, space).groupBy("b", "yb")
            .agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2")))


def colset_key(positions: Sequence[int]) -> str:
    return ",".join(str(p) for p in sorted(positions))


def marginals(cube: DataFrame, colsets: Sequence[Sequence[int]]) -> DataFrame:
    """Projection of the cube on each column set: ``(cs, key array<int>, yb, n, s1, s2)``.

    One pass over the cube: every cell emits one row per column set (a generator, not a join),
    then the partial aggregate collapses them. The result has at most ``prod(buckets of S) x
    (#splits + 1)`` rows per set ``S``.
    """
    sets = sorted({tuple(sorted(s)) for s in colsets})
    if not sets:
        sets = [()]
    entries = [F.struct(F.lit(colset_key(s)).alias("cs"),
                        F.array(*[F.col("b")[p] for p in s]).cast("array<int>").alias("key"))
               for s in sets]
    return (cube.select(F.explode(F.array(*entries)).alias("m"), "yb", "n", "s1", "s2")
                .groupBy(F.col("m.cs").alias("cs"), F.col("m.key").alias("key"), "yb")
                .agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2")))


def positive(yb: Column, lo_y: int, hi_y: int) -> Column:
    return (yb > F.lit(lo_y)) & (yb <= F.lit(hi_y))


def label_counts(cube: DataFrame, lo_y: int = 0, hi_y: int = 1) -> DataFrame:
    """Number of positives (target in the interval) and negatives, one row."""
    pos = positive(F.col("yb"), lo_y, hi_y)
    return cube.agg(F.sum(F.when(pos, F.col("n")).otherwise(F.lit(0))).cast("long").alias("positives"),
                    F.sum(F.when(~pos, F.col("n")).otherwise(F.lit(0))).cast("long").alias("negatives"))


def threshold_counts(cube: DataFrame, space: Space, lo_y: int = 0, hi_y: int = 1) -> DataFrame:
    """Per (column, threshold index): positives and negatives with ``x >= t``.

    The by-value table of the source model: ``b(x) > i`` <=> ``x >= t_i``.
    """
    cells = cube.select(F.posexplode("b").alias("pos", "bucket"), "yb", "n")
    pos = positive(F.col("yb"), lo_y, hi_y)
    idx = [F.struct(F.lit(p).alias("pos"), F.lit(i).alias("i"), F.lit(float(t)).alias("threshold"))
           for p, c in enumerate(space.cols) for i, t in enumerate(space.thresholds[c])]
    per_bucket = (cells.groupBy("pos", "bucket")
                       .agg(F.sum(F.when(pos, F.col("n")).otherwise(F.lit(0))).alias("np"),
                            F.sum(F.when(~pos, F.col("n")).otherwise(F.lit(0))).alias("nn")))
    # each bucket b counts for every threshold index i < b: expand i over a literal list
    grid = per_bucket.select("pos", "bucket", "np", "nn",
                             F.explode(F.filter(F.array(*idx), lambda s: s["pos"] == F.col("pos")))
                             .alias("t"))
    hit = F.col("bucket") > F.col("t.i")
    cols_map = F.create_map(*[x for p, c in enumerate(space.cols) for x in (F.lit(p), F.lit(c))])
    return (grid.groupBy(F.col("t.pos").alias("pos"), F.col("t.i").alias("i"),
                         F.col("t.threshold").alias("threshold"))
                .agg(F.sum(F.when(hit, F.col("np")).otherwise(F.lit(0))).cast("long").alias("positives"),
                     F.sum(F.when(hit, F.col("nn")).otherwise(F.lit(0))).cast("long").alias("negatives"))
                .select(cols_map[F.col("pos")].alias("col"), "i", "threshold", "positives", "negatives"))
