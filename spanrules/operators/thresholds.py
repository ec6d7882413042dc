"""Split values per column: exact quantiles by narrowing value ranges.

A threshold list is sorted, has distinct values and ends with ``max + 1``, so every condition
``t_lo <= x < t_hi`` is a range of buckets (see :mod:`spanrules.operators.cube`). Lists are small
(one value per quantile) and are returned to the driver as ``{column: [t0, t1, ...]}``.

:func:`select_quantiles` finds all quantiles of all columns together. Each pass counts the values of every
open range in ``BINS`` bins of equal width, with the least and greatest value of each bin; the bin that
holds the wanted rank, cut to these two values, is the next range. A range whose ends are equal is the answer.
Passes combine map-side and return ``BINS`` rows per open range at most, whatever the number of
distinct values; two or three passes are the rule, as each cuts a range to a thousandth or less.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanrules.functions.columns import clean_double, literal_frame, qcol


BINS = 1024


def select_quantiles(traces: DataFrame, wanted: dict[str, Sequence[float]]
                     ) -> tuple[dict[str, list[float | None]], dict[str, tuple[float | None, float | None]]]:
    """Exact discrete quantiles (SQL ``percentile_disc``: the least value with at least ``q`` of the values at or
    below it; NULL and NaN are missing) of several columns, and the least and greatest value of each."""
    cols = list(wanted)
    ends = traces.agg(*[x for i, c in enumerate(cols) for x in (
        F.min(clean_double(qcol(c))).alias(f"lo{i}"), F.max(clean_double(qcol(c))).alias(f"hi{i}"),
        F.count(clean_double(qcol(c))).alias(f"n{i}"))]).first()
    span = {c: (ends[f"lo{i}"], ends[f"hi{i}"]) for i, c in enumerate(cols)}
    found: dict[tuple[int, int], float | None] = {}
    # of each wanted value: the range it lies in, and its rank among the values of that range
    open_: dict[tuple[int, int], tuple[float, float, int]] = {}
    for i, c in enumerate(cols):
        for j, q in enumerate(wanted[c]):
            n = ends[f"n{i}"]
            if not n:
                found[i, j] = None
            else:
                open_[i, j] = (*span[c], max(1, math.ceil(q * n)))
    while True:
        for key, (lo, hi, _) in list(open_.items()):
            if lo == hi:
                found[key] = lo
                del open_[key]
        if not open_:
            break
        ranges = sorted({(i, lo, hi) for (i, _), (lo, hi, _) in open_.items()})
        counted: dict[tuple[int, float, float], list] = {r: [] for r in ranges}
        for r in _bin_counts(traces, cols, ranges).collect():
            counted[ranges[r["r"]]].append(r)
        for key, (lo, hi, rank) in open_.items():
            for b in sorted(counted[key[0], lo, hi], key=lambda b: b["bin"]):
                if rank <= b["n"]:
                    open_[key] = (b["least"], b["most"], rank)
                    break
                rank -= b["n"]
    return {c: [found[i, j] for j in range(len(wanted[c]))] for i, c in enumerate(cols)}, span


def _range(k: int, lo: float, hi: float) -> Column:
    """Range ``k`` as a literal: its ends, the finite ends that its bins divide, and their distance. Where that is not
    finite, all is taken by halves."""
    low, high = max(lo, -sys.float_info.max), min(hi, sys.float_info.max)
    part = 1.0 if math.isfinite(high - low) else 0.5
    values = {"lo": lo, "hi": hi, "low": low, "high": high, "part": part, "width": high * part - low * part}
    return F.struct(F.lit(k).alias("k"), *[F.lit(v).alias(n) for n, v in values.items()])


def _bin_counts(traces: DataFrame, cols: Sequence[str], ranges: Sequence[tuple[int, float, float]]) -> DataFrame:
    """``(r, bin, n, least, most)``: the values in bins of each range ``(column, lo, hi)``; ranges of a column
    are disjoint or the same. The first bin holds the range's least value and the last one its greatest, so no
    bin holds all."""
    used = sorted({p for p, _, _ in ranges})
    values = F.array(*[F.struct(F.lit(u).alias("u"), clean_double(qcol(cols[i])).alias("v")) for u, i in enumerate(used)])
    of_column = F.array(*[F.array(*[_range(k, lo, hi) for k, (p, lo, hi) in enumerate(ranges) if p == i]) for i in used])
    found = traces.select(F.inline(values)).where("v IS NOT NULL").select(
        "v", F.get(F.filter(of_column[F.col("u")], lambda r: (F.col("v") >= r["lo"]) & (F.col("v") <= r["hi"])), F.lit(0)).alias("r"))
    r, v = F.col("r"), F.col("v")
    share = F.try_divide(v * r["part"] - r["low"] * r["part"], r["width"])
    cell = (F.when(v >= r["high"], F.lit(BINS - 1)).when(v <= r["low"], F.lit(0))
            .otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1)))).cast("int")
    return (found.where("r IS NOT NULL").select(r["k"].alias("r"), cell.alias("bin"), "v").groupBy("r", "bin")
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most")))


def rule_columns(traces: DataFrame, suffix: str = "avg_self_dur") -> list[str]:
    """Columns ending with ``suffix`` (not ``traceId``), sorted by name."""
    return sorted(c for c in traces.columns if c != "traceId" and c.endswith(suffix))


def _finish(values: list, top) -> list[float]:
    vals = sorted({float(v) for v in values if v is not None})
    if top is not None:
        vals = sorted(set(vals) | {float(top) + 1.0})
    return vals


def quantile_thresholds(traces: DataFrame, cols: Sequence[str], quantiles: Sequence[float],
                        with_min: bool = False) -> dict[str, list[float]]:
    """``[min?, q1, .., qk, max + 1]`` per column, exact, all columns in the same passes."""
    values, ends = select_quantiles(traces, {c: quantiles for c in cols})
    return {c: _finish([*values[c], *([ends[c][0]] if with_min else [])], ends[c][1]) for c in cols}


def space_summary(traces: DataFrame, cols: Sequence[str], quantiles: Sequence[float], target: str,
                  target_quantiles: Sequence[float], with_min: bool = False
                  ) -> tuple[dict[str, list[float]], list[float], float]:
    """Thresholds of the rule columns, quantiles and max of the target, in the same passes."""
    wanted = {c: list(quantiles) for c in cols}
    both = wanted.get(target, [])
    values, ends = select_quantiles(traces, wanted | {target: [*both, *target_quantiles]})
    th = {c: _finish([*values[c][:len(quantiles)], *([ends[c][0]] if with_min else [])], ends[c][1]) for c in cols}
    return th, [float(v) for v in values[target][len(both):]], float(ends[target][1])


def exact_quantiles(traces: DataFrame, col: str, quantiles: Sequence[float]) -> list[float]:
    """Exact discrete quantiles of one column (e.g. split points of the target)."""
    values, _ = select_quantiles(traces, {col: quantiles})
    return [float(v) for v in values[col]]


def column_max(traces: DataFrame, col: str) -> float:
    return float(traces.agg(F.max(clean_double(qcol(col)))).collect()[0][0])


THRESHOLD_SCHEMA = T.StructType([
    T.StructField("col", T.StringType(), False),
    T.StructField("pos", T.IntegerType(), False),
    T.StructField("i", T.IntegerType(), False),
    T.StructField("threshold", T.DoubleType(), False),
])


def thresholds_frame(spark: SparkSession, thresholds: dict[str, list[float]],
                     cols: Sequence[str] | None = None) -> DataFrame:
    """``(col, pos, i, threshold)``: one row per threshold, ``pos`` = column position."""
    cols = list(cols or thresholds)
    rows = [(c, p, i, float(t)) for p, c in enumerate(cols) for i, t in enumerate(thresholds[c])]
    return literal_frame(spark, rows, THRESHOLD_SCHEMA)
