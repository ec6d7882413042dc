"""Split values by 1-D mean-shift (flat kernel, binned seeds), all rule columns in the same jobs.

Every step works on the value histogram ``(col, v, w)`` (``w`` = number of traces with value
``v``), which Spark builds with one partial aggregation, and is a DataFrame plan in which no column, whatever
its number of values, goes through one task.

1. bandwidth: mean over all points of the distance to their ``k``-th nearest neighbour, the point
   itself included, ``k = max(1, int(0.1 n))``; exact. The ``k`` points around a value are ``k``
   neighbours in the order of all points, a window with first value ``a`` and last value ``b``; the distance
   is the least ``max(v - a, b - v)`` over all windows, which the last window with ``a + b <= 2 v`` or the
   first one after it gives. Windows come from running weights, both lookups are running last values
   over values and windows sorted together (:mod:`spanrules.operators.ordered`).
2. seeds: bins ``round_half_even(v / bw)`` holding at least ``min_bin_freq`` points, at
   ``bin * bw``.
3. shift: every seed moves to the mean of the points within ``bw`` (inclusive) until it moves
   less than ``1e-3 bw``; seeds with no point are dropped. The neighbourhood is a
   band join: histogram keyed by ``floor(v / bw)``, seeds probing their bucket and the two next
   to it (an equi-join), then ``|v - mean| <= bw``. A seed climbs, so it comes to rest on its own; ``max_iter``
   may end it before.
4. modes: by intensity (points within), a mode closer than ``bw`` to a stronger kept one is dropped: a fixed
   point. In each round the strongest undecided mode of a cell of width ``bw`` is kept if no stronger
   undecided one of the cells beside it is within reach, and what is within reach of a kept one falls.
5. labels: nearest mode; thresholds = the smallest value of each cluster, plus ``max + 1``.
   ``min == max`` gives ``[min, min + 1]``; bandwidth 0 gives ``[min, max + 1]``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanrules.functions.columns import clean_double, qcol
from spanrules.operators.ordered import positions, running
from spanrules.session import cut_lineage

BROADCAST_BYTES = 16 << 20
HIST_BYTES = 64  # of a histogram row, beside the name of its column


def value_histogram(traces: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(col, v, w)``: distinct non-missing values per column with their counts."""
    entries = F.array(*[F.struct(F.lit(c).alias("col"), clean_double(qcol(c)).alias("v")) for c in cols])
    return (traces.select(F.explode(entries).alias("e"))
                  .select("e.col", "e.v").filter(F.col("v").isNotNull())
                  .groupBy("col", "v").agg(F.count(F.lit(1)).alias("w")))


def _windows(hist: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows of ``k`` points in order: ``(col, a, b)``, and the least ``k`` needed of each column's values."""
    ranked = cut_lineage(running(hist, "col", ["v"], sums={"upto": "w"}).join(F.broadcast(sizes), "col"))
    # a window changes where its first or its last point takes a new value
    first = ranked.select("col", "k", "n", (F.col("upto") - F.col("w") + 1).alias("rank"), F.col("v").alias("a"), F.lit(None).cast("double").alias("b"))
    last = ranked.select("col", "k", "n", (F.col("upto") - F.col("w") + 2 - F.col("k")).alias("rank"), F.lit(None).cast("double").alias("a"), F.col("v").alias("b"))
    # what a window starts and ends with at any rank are the last values given for it
    starts = running(first.unionByName(last), "col", ["rank"], lasts={"first": "a", "end": "b"})
    # (of equal ranks the row that has seen all of them has the greatest of both)
    whole = (starts.where((F.col("rank") >= 1) & (F.col("rank") <= F.col("n") - F.col("k") + 1))
             .groupBy("col", "rank").agg(F.max("first").alias("a"), F.max("end").alias("b")))
    return whole.select("col", "a", "b"), ranked


def kth_distance(hist: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(col, v, w, d)``: distance of every value to its ``k``-th nearest point, itself included. ``sizes`` has
    ``col, n, k``."""
    windows, ranked = _windows(hist, sizes)
    none = F.lit(None).cast("double")
    windows = windows.select("col", (F.col("a") + F.col("b")).alias("at"), F.lit(0).alias("kind"), "a", "b", none.alias("v"), F.lit(None).cast("long").alias("w"))
    values = ranked.select("col", (2 * F.col("v")).alias("at"), F.lit(1).alias("kind"), none.alias("a"), none.alias("b"), "v", "w")
    # upwards: the last window with a + b <= 2 v; downwards: the last one with a + b > 2 v
    up = running(windows.unionByName(values), "col", ["at", "kind"], lasts={"below": "a"})
    down = running(up.withColumn("back", -F.col("at")).withColumn("turn", -F.col("kind")), "col", ["back", "turn"], lasts={"above": "b"})
    far = F.lit(float("inf"))
    return down.where("kind = 1").select("col", "v", "w", F.least(
        F.coalesce(F.col("v") - F.col("below"), far), F.coalesce(F.col("above") - F.col("v"), far)).alias("d"))


def bandwidth(hist: DataFrame, quantile: float = 0.1) -> DataFrame:
    """``(col, n, k, bandwidth, vmin, vmax)`` per column."""
    hist = cut_lineage(hist)
    sizes = cut_lineage(hist.groupBy("col").agg(F.sum("w").alias("n"), F.min("v").alias("vmin"), F.max("v").alias("vmax"))
                        .withColumn("k", F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(quantile))).cast("long")))
    far = kth_distance(hist, sizes.select("col", "n", "k"))
    total = far.groupBy("col").agg(F.sum(F.col("d") * F.col("w")).alias("total"))
    return (total.join(sizes, "col")
            .select("col", "n", "k", (F.col("total") / F.col("n")).alias("bandwidth"), "vmin", "vmax"))


def seeds(hist: DataFrame, bw: DataFrame, min_bin_freq: int = 1) -> DataFrame:
    """Binned seeds ``(col, sid, mean)``; all distinct values when every point has its own bin."""
    h = hist.join(F.broadcast(bw.select("col", "bandwidth", "n")), "col").filter(F.col("bandwidth") > 0)
    binned = (h.withColumn("bin", F.bround(F.col("v") / F.col("bandwidth"), 0))
               .groupBy("col", "bin", "bandwidth", "n").agg(F.sum("w").alias("f")))
    nbins = binned.groupBy("col").agg(F.count(F.lit(1)).alias("nb"))
    own = (h.join(nbins, "col").filter(F.col("nb") == F.col("n"))
            .select("col", F.col("v").alias("mean")))
    binned = (binned.join(nbins, "col").filter((F.col("nb") != F.col("n")) & (F.col("f") >= min_bin_freq))
                    .select("col", (F.col("bin") * F.col("bandwidth")).alias("mean")))
    s = binned.unionByName(own)
    return positions(s, "col", ["mean"], "sid")


def _cells(x: str, reach: tuple[int, ...]) -> Column:
    """The cell of a value, one bandwidth wide, and those beside it."""
    return F.array(*[(F.floor(F.col(x) / F.col("bandwidth")) + F.lit(d)).cast("long") for d in reach])


def _step(state: DataFrame, keyed: DataFrame, max_iter: int | None) -> DataFrame:
    """One mean-shift step for every seed, in one pass (converged seeds pass through).

    Each seed probes its value bucket and the two next to it (equi-join on ``(col, cell)``);
    points farther than the bandwidth are masked in the sums, not filtered, so every seed keeps
    its row. A moving seed with no point in reach is dropped.
    """
    probe = state.select("*", F.explode(_cells("mean", (-1, 0, 1))).alias("cell"))
    joined = probe.join(keyed, ["col", "cell"], "left")
    inside = F.abs(F.col("v") - F.col("mean")) <= F.col("bandwidth")
    agg = (joined.groupBy("col", "sid", "mean", "bandwidth", "done", "it", "intensity")
                 .agg(F.sum(F.when(inside, F.col("v") * F.col("w"))).alias("svw"),
                      F.sum(F.when(inside, F.col("w"))).alias("sw")))
    new = F.col("svw") / F.col("sw")
    moved = F.abs(new - F.col("mean")) < F.lit(1e-3) * F.col("bandwidth")
    if max_iter is not None:
        moved = moved | (F.col("it") >= max_iter)
    return (agg.filter(F.col("done") | (F.coalesce(F.col("sw"), F.lit(0)) > 0))
               .select("col", "sid",
                       F.when(F.col("done"), F.col("mean")).otherwise(new).alias("mean"),
                       "bandwidth",
                       (F.col("done") | moved).alias("done"),
                       F.when(F.col("done"), F.col("it")).otherwise(F.col("it") + 1).alias("it"),
                       F.when(F.col("done"), F.col("intensity")).otherwise(F.col("sw")).cast("long")
                       .alias("intensity")))


def shift(hist: DataFrame, bw: DataFrame, start: DataFrame, max_iter: int | None = None,
          steps_per_job: int = 6) -> DataFrame:
    """Mean-shift every seed to convergence: ``(col, sid, mean, intensity)``.

    ``steps_per_job`` steps are chained in one plan (each step reads the previous state once,
    so the plan grows linearly), then the state is checkpointed and checked for active seeds.
    """
    b = F.broadcast(bw.select("col", "bandwidth").filter(F.col("bandwidth") > 0))
    keyed = (hist.join(b, "col")
                 .withColumn("cell", _cells("v", (0,))[0])
                 .select("col", "cell", "v", "w"))
    keyed = cut_lineage(keyed)
    # the histogram (distinct values per column) is measured once; under the limit every step
    # broadcasts it and streams the seeds, so a step shuffles only for its aggregate
    name = keyed.agg(F.max(F.octet_length("col"))).first()[0] or 0
    if keyed.count() * (HIST_BYTES + name) <= BROADCAST_BYTES:
        keyed = F.broadcast(keyed)
    state = (start.join(b, "col")
                  .select("col", "sid", "mean", "bandwidth", F.lit(False).alias("done"),
                          F.lit(0).alias("it"), F.lit(0).cast("long").alias("intensity")))
    state = cut_lineage(state)
    while True:
        for _ in range(steps_per_job):
            state = _step(state, keyed, max_iter)
        state = cut_lineage(state)
        if state.filter(~F.col("done")).isEmpty():
            break
    return state.select("col", "sid", "mean", "intensity")


def _within_reach(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs of a row and another (``o_mean, o_rank, o_cell``) at most a bandwidth away: an equi-join on cells, the
    row's own and those beside it (one more for the rounding of a cell's edge)."""
    probe = rows.select("*", F.explode(_cells("mean", (-2, -1, 0, 1, 2))).alias("at"))
    there = others.select(F.col("col").alias("o_col"), F.col("mean").alias("o_mean"), F.col("rank").alias("o_rank"), F.col("cell").alias("o_cell"))
    return probe.join(there, (F.col("col") == F.col("o_col")) & (F.col("at") == F.col("o_cell"))
                      & (F.abs(F.col("mean") - F.col("o_mean")) <= F.col("bandwidth"))).drop("at", "o_col")


def modes(shifted: DataFrame, bw: DataFrame) -> DataFrame:
    """``(col, mean, intensity, kept, rank)``: converged seeds (equal means once), strongest first (ties: the smaller
    mean); ``kept`` marks the cluster centres (no stronger centre within the bandwidth)."""
    found = shifted.groupBy("col", "mean").agg(F.max("intensity").alias("intensity"))
    found = positions(found.withColumn("weak", -F.col("intensity")), "col", ["weak", "mean"], "rank")
    ranked = cut_lineage(found.join(F.broadcast(bw.select("col", "bandwidth")), "col")
                         .select("col", "mean", "intensity", (F.col("rank") - 1).alias("rank"), "bandwidth", _cells("mean", (0,))[0].alias("cell")))
    undecided, kept = ranked, []
    while True:
        # one of a cell can be kept at most: its strongest
        lead = undecided.groupBy("col", "cell").agg(F.min_by(F.struct("mean", "rank", "bandwidth"), "rank").alias("x")).select("col", "cell", "x.*")
        beaten = _within_reach(lead, undecided).where(F.col("o_rank") < F.col("rank")).select("col", "rank").distinct()
        new = cut_lineage(lead.join(beaten, ["col", "rank"], "left_anti"))
        if new.isEmpty():
            break
        kept.append(new.select("col", "rank"))
        fallen = _within_reach(undecided, new).select("col", "rank").distinct()
        undecided = cut_lineage(undecided.join(fallen, ["col", "rank"], "left_anti"))
    out = ranked.select("col", "mean", "intensity", "rank")
    if not kept:
        return out.withColumn("kept", F.lit(False)).select("col", "mean", "intensity", "kept", "rank")
    centres = kept[0]
    for more in kept[1:]:
        centres = centres.unionByName(more)
    return (out.join(centres.withColumn("kept", F.lit(True)), ["col", "rank"], "left")
            .select("col", "mean", "intensity", F.coalesce("kept", F.lit(False)).alias("kept"), "rank"))


def labels(hist: DataFrame, centres: DataFrame) -> DataFrame:
    """Nearest centre per histogram value (ties to the stronger centre): ``(col, v, w, label)``.

    Centres of a column (few, at least a bandwidth apart) are gathered into one sorted array;
    each value finds its Voronoi cell by scanning the midpoints, so no value x centre pairs are
    materialised.
    """
    c = (centres.filter("kept").groupBy("col")
                .agg(F.array_sort(F.collect_list(F.struct("mean", "rank"))).alias("cs")))
    h = hist.join(F.broadcast(c), "col")
    nxt = lambda i: F.get(F.col("cs"), i + 1)
    # k = number of midpoints strictly below v
    mids = F.transform(F.sequence(F.lit(0), F.size("cs") - 2),
                       lambda i: (F.get(F.col("cs"), i)["mean"] + nxt(i)["mean"]) / 2.0)
    mids = F.when(F.size("cs") > 1, mids).otherwise(F.array().cast("array<double>"))
    k = F.size(F.filter(mids, lambda m: m < F.col("v")))
    at = F.get(F.col("cs"), k)
    tie = F.get(mids, k) == F.col("v")
    alt = F.get(F.col("cs"), k + 1)
    chosen = F.when(tie & (alt["rank"] < at["rank"]), alt).otherwise(at)
    return h.select("col", "v", "w", chosen["mean"].alias("label"))


def meanshift_thresholds(traces: DataFrame, cols: Sequence[str], bw_value: float | None = None,
                         min_bin_freq: int = 1, max_iter: int | None = None,
                         quantile: float = 0.1) -> dict[str, list[float]]:
    """Mean-shift thresholds per column, ``{col: [..., max + 1]}``."""
    hist = cut_lineage(value_histogram(traces, cols))
    bw = bandwidth(hist, quantile)
    if bw_value is not None:
        bw = bw.withColumn("bandwidth", F.lit(float(bw_value)))
    bw = cut_lineage(bw)
    shifted = shift(hist, bw, seeds(hist, bw, min_bin_freq), max_iter)
    cent = cut_lineage(modes(shifted, bw))
    lab = labels(hist, cent)
    mins = lab.groupBy("col", "label").agg(F.min("v").alias("t"))
    got = {c: [] for c in cols}
    for r in mins.collect():
        got[r["col"]].append(float(r["t"]))
    out = {}
    for r in bw.collect():
        c, lo, hi = r["col"], float(r["vmin"]), float(r["vmax"])
        if lo == hi:
            out[c] = [lo, lo + 1.0]
        elif r["bandwidth"] <= 0 or not got.get(c):
            out[c] = [lo, hi + 1.0]
        else:
            out[c] = sorted(set(got[c]) | {hi + 1.0})
    return {c: out[c] for c in cols if c in out}
