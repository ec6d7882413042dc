"""Segmentation of the latency range into consecutive intervals with the best total F-measure.

Split points ``s_0 < ... < s_n`` (exact quantiles of the target). The cube carries the target
bucket ``yb``, so the best rule of every interval ``(s_j, s_i]`` is found in one search over all
``n(n+1)/2`` intervals at once (interval = a grouping key), instead of one search per call of a
recursion. The dynamic programme then runs over the small interval table: ``best[i] = max_j
best[j] + F(j, i)``, ties to the smallest ``j``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanrules.functions.columns import literal_frame
from spanrules.operators import search
from spanrules.operators.cube import Space, bucket_cube
from spanrules.operators.thresholds import exact_quantiles
from spanrules.session import cut_lineage


def split_points(traces: DataFrame, target: str, quantiles: Sequence[float]) -> list[float]:
    """Sorted distinct split points (exact quantiles of the target)."""
    return sorted(set(exact_quantiles(traces, target, quantiles)))


def all_intervals(n_points: int) -> list[tuple[int, int]]:
    return [(j, i) for i in range(1, n_points) for j in range(i)]


def segment_intervals(spark: SparkSession, splits: Sequence[float]) -> DataFrame:
    rows = [(j, i, float(splits[j]), float(splits[i])) for j, i in all_intervals(len(splits))]
    return literal_frame(spark, rows, "j int, i int, s_from double, s_to double")


def segmentation_space(space: Space, splits: Sequence[float]) -> Space:
    return Space(space.cols, space.thresholds, space.target, tuple(float(s) for s in splits))


def segment_scores(traces: DataFrame, space: Space, splits: Sequence[float],
                   explainer: str = "bnb") -> DataFrame:
    """Best rule per interval ``(s_j, s_i]``: ``j, i, s_from, s_to`` + the scored rule."""
    seg = segmentation_space(space, splits)
    cube = cut_lineage(bucket_cube(traces, seg))
    ivs = all_intervals(len(splits))
    if explainer == "bnb":
        best = search.branch_and_bound(cube, seg, ivs)
    else:
        best = search.best_rule(cube, seg, intervals=ivs)
    return best.join(F.broadcast(segment_intervals(traces.sparkSession, splits)), ["j", "i"])


def best_segmentation(scores: DataFrame, n_points: int) -> DataFrame:
    """Dynamic programme over the interval scores.

    ``scores``: ``j, i, fmeasure`` (+ anything else). Returns one row per chosen interval, in
    order: ``seg, j, i, fmeasure, total`` (``total`` = the best sum for the whole range). With a
    single split point the answer is empty, as it is if no chain of intervals spans the range.

    The interval scores, one row per pair of split points, become one row with an array per
    interval end; one fold over the split points carries the best total and its last start, a second
    one walks back. The plan has the same size for any number of split points.
    """
    n = max(n_points - 1, 0)
    by_end = (scores.where(F.col("fmeasure").isNotNull()).groupBy("i")
              .agg(F.collect_list(F.struct("j", "fmeasure")).alias("from"))
              .agg(F.map_from_entries(F.collect_list(F.struct("i", "from"))).alias("ends")))
    state = "array<struct<loss: double, j: int>>"

    def step(done: Column, i: Column) -> Column:
        # the least loss (the negated total), then the smallest start
        reach = F.transform(F.col("ends")[i], lambda e: F.struct(
            (done[e["j"]]["loss"] - e["fmeasure"]).alias("loss"), e["j"].cast("int").alias("j")))
        best = F.array_min(F.filter(reach, lambda r: r["loss"].isNotNull()))
        return F.concat(done, F.array(best).cast(state))

    ends = F.sequence(F.lit(1), F.lit(max(n, 1)))
    first = F.array(F.struct(F.lit(0.0).alias("loss"), F.lit(-1).alias("j"))).cast(state)
    done = by_end.select(F.aggregate(ends, first, step).alias("done"))

    def back(path: Column, _: Column) -> Column:
        return F.when(path[0] <= 0, path).otherwise(F.concat(F.array(F.col("done")[path[0]]["j"]), path))

    path = F.aggregate(ends, F.array(F.lit(n)).cast("array<int>"), back)
    chosen = (done.where(F.lit(n > 0)).select((-F.get("done", F.lit(n))["loss"]).alias("total"), path.alias("path"))
              .where("total IS NOT NULL")
              .select("total", "path", F.posexplode(F.expr("slice(path, 1, size(path) - 1)")).alias("seg", "j"))
              .select("seg", "j", F.col("path")[F.col("seg") + 1].alias("i"), "total"))
    return chosen.join(scores, ["j", "i"])
