"""Multi-objective selection over scored rule sets: Pareto front, crowding, F-beta sweep.

Objectives: precision (max), recall (max), dissimilarity (min).

The front is found by divide and conquer. In the order of precision (then recall, then dissimilarity) a point
can only be dominated by one before it. Tasks first reduce what they hold to its own front. The points left
are dealt by ranges of that order, blocks of bounded size, each reduced to its front in its task; then
neighbouring blocks are merged in ``log2(blocks)`` rounds: a point of the later half of a merged block
falls if some point of the earlier half has no less recall and no more dissimilarity, which is a
running minimum of the earlier half's dissimilarity by falling recall. All merges of a round are one such
running minimum (:mod:`spanrules.operators.ordered`), so no task ever holds the front.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanrules.functions.columns import beta_fscore
from spanrules.operators.ordered import neighbours, running
from spanrules.session import cut_lineage, ship_by_value

OBJECTIVES = (("fit_p", 1.0), ("fit_r", 1.0), ("fit_d", -1.0))
BLOCK_POINTS = 50_000

ship_by_value(__name__)


class Staircase:
    """Points ``(r, d)`` of which none has both more ``r`` and less ``d`` than another: by rising ``r``, ``d`` rises."""

    def __init__(self):
        self.r: list[float] = []
        self.d: list[float] = []

    def least(self, r: float) -> float:
        """The least ``d`` of the points with at least this ``r``."""
        at = bisect_left(self.r, r)
        return self.d[at] if at < len(self.r) else float("inf")

    def covers(self, r: float, d: float) -> bool:
        at = bisect_left(self.r, r)
        return at < len(self.r) and self.d[at] <= d

    def add(self, r: float, d: float) -> None:
        """Adds a point that is not covered; the points that it covers go."""
        last = bisect_left(self.r, r)
        first = last
        while first > 0 and self.d[first - 1] >= d:
            first -= 1
        if last < len(self.r) and self.r[last] == r:
            last += 1
        self.r[first:last], self.d[first:last] = [r], [d]


def _front_of(table: pa.Table) -> pa.Table:
    """The non-dominated ones of distinct points, ``n log n``."""
    p, r, d = (table.column(c).to_numpy() for c, _ in OBJECTIVES)
    stairs, kept = Staircase(), []
    for i in np.lexsort((d, -r, -p)):
        if not stairs.covers(r[i], d[i]):
            kept.append(i)
            stairs.add(r[i], d[i])
    return table.take(pa.array(kept, pa.int64()))


def _skyline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The front of a task's points; it holds the front so far and one batch."""
    front = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        front = _front_of(new if front is None else pa.concat_tables([front, new]))
    if front is not None:
        yield from front.combine_chunks().to_batches()


def pareto_front(fit: DataFrame, key: str = "set_id") -> DataFrame:
    """Non-dominated rows; equal fitness kept once (smallest key). ``fit`` has ``key, fit_p, fit_r, fit_d``."""
    pts = fit.groupBy("fit_p", "fit_r", "fit_d").agg(F.min(key).alias(key))
    left = cut_lineage(pts.mapInArrow(_skyline, pts.schema))
    blocks = 1 + left.count() // BLOCK_POINTS
    order = [F.col("fit_p").desc(), F.col("fit_r").desc(), F.col("fit_d")]
    left = left.repartitionByRange(blocks, *order).mapInArrow(_skyline, pts.schema)
    if blocks > 1:
        left = cut_lineage(left.withColumn("block", F.spark_partition_id()))
        level = 0
        while blocks >> level:
            # halves of a merged block: the earlier one is even, the later one odd
            halved = left.withColumn("half", F.shiftright("block", level) % 2).withColumn("pair", F.shiftright("block", level + 1))
            halved = halved.withColumn("fall", -F.col("fit_r")).withColumn("early", F.when(F.col("half") == 0, F.col("fit_d")))
            met = running(halved, "pair", ["fall", "half"], mins={"least": "early"})
            beaten = (F.col("half") == 1) & F.coalesce(F.col("least") <= F.col("fit_d"), F.lit(False))
            left = cut_lineage(met.where(~beaten).select(*pts.columns, "block"))
            level += 1
    return fit.join(left.select(key), key, "left_semi")


def dominated(points: DataFrame, front: DataFrame, key: str = "set_id") -> DataFrame:
    """Keys of the points (``key, fit_p, fit_r, fit_d``) that some other point of the front dominates. The front
    goes to the tasks in portions of at most ``BLOCK_POINTS``."""
    front = cut_lineage(front.select("fit_p", "fit_r", "fit_d").distinct())
    portions = 1 + front.count() // BLOCK_POINTS
    kind = points.schema[key].dataType.simpleString()
    out = None
    for k in range(portions):
        part = front if portions == 1 else front.where(F.pmod(F.hash("fit_p", "fit_r", "fit_d"), F.lit(portions)) == k)
        rows = sorted(((-r["fit_p"], r["fit_r"], r["fit_d"]) for r in part.collect()))
        shared = points.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            rows = shared.value
            own = set(rows)
            for batch in batches:
                p, r, d = (batch.column(c).to_numpy() for c, _ in OBJECTIVES)
                stairs, at, hit = Staircase(), 0, []
                for i in np.argsort(-p, kind="stable"):
                    while at < len(rows) and -rows[at][0] >= p[i]:
                        if not stairs.covers(*rows[at][1:]):
                            stairs.add(*rows[at][1:])
                        at += 1
                    if stairs.covers(r[i], d[i]) and (-p[i], r[i], d[i]) not in own:
                        hit.append(i)
                yield pa.record_batch([batch.column(key).take(pa.array(hit, pa.int64()))], names=[key])

        found = points.select(key, "fit_p", "fit_r", "fit_d").mapInArrow(run, f"{key} {kind}")
        out = found if out is None else out.unionByName(found)
    return out.distinct() if portions > 1 else out


def crowding_distance(front: DataFrame, key: str = "set_id", objectives=OBJECTIVES) -> DataFrame:
    """NSGA-II crowding distance (Deb et al. 2002) of each point of a front.

    Per objective the points are ordered (ties by ``key``); the two ends get infinity, the others
    ``(next - prev) / (n_objectives * (max - min))``, skipped when ``max == min``. Neighbours come from
    positions in the global order, so a front of any size spreads over many tasks.
    """
    front = cut_lineage(front)
    ends = front.agg(*[f(F.col(c) * F.lit(w)).alias(f"{n}{i}") for i, (c, w) in enumerate(objectives)
                       for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = front.withColumn("_front", F.lit(0)).withColumn("crowding", F.lit(0.0))
    for i, (c, w) in enumerate(objectives):
        v = F.col(c) * F.lit(w)
        near = neighbours(out.withColumn("_v", v), "_front", ["_v", key], F.col("_v"), "_prev", "_next")
        norm = float(len(objectives)) * ((ends[f"hi{i}"] or 0.0) - (ends[f"lo{i}"] or 0.0))
        d = F.lit(0.0) if norm == 0 else F.try_divide(F.col("_next") - F.col("_prev"), F.lit(norm))
        d = F.when(F.col("_prev").isNull() | F.col("_next").isNull(), F.lit(float("inf"))).otherwise(d)
        out = near.withColumn("crowding", F.col("crowding") + d).drop("_v", "_prev", "_next")
    return out.drop("_front")


def beta_best(front: DataFrame, key: str = "set_id", lo: int = 10, hi: int = 100,
              step_den: float = 100.0) -> DataFrame:
    """Best rule set of a front by an F-beta sweep, ``beta = lo/100 .. hi/100``.

    Per beta: highest F-beta, ties to the least dissimilarity, then smallest key. Among the
    winners: least dissimilarity, then smallest beta. One row with ``beta`` = the winning beta.
    """
    betas = (front.select("*", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("_bi"))
                  .withColumn("beta", F.col("_bi").cast("double") / F.lit(step_den)).drop("_bi"))
    scored = betas.withColumn("fbeta", beta_fscore(F.col("precision"), F.col("recall"), F.col("beta")))
    per_beta = (scored.groupBy("beta")
                      .agg(F.min_by(F.struct(*front.columns),
                                    F.struct((-F.col("fbeta")).alias("f"), F.col("dissimilarity").alias("d"),
                                             F.col(key).alias("k"))).alias("w")))
    return (per_beta.agg(F.min_by(F.struct("w.*", "beta"),
                                  F.struct(F.col("w.dissimilarity").alias("d"), F.col("beta").alias("b")))
                         .alias("best"))
                    .select("best.*"))
