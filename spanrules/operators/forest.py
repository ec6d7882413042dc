"""Forest predicates: range predicates read off a forest of exact-split trees that separates slow requests.

Trees are grown level by level, all of a forest together, as DataFrame plans. A *region* is the box of values
that a node stands for; nodes of different trees with the same region (most of those near the roots) share
all work on it. Per level:

* histogram: the traces of each region counted by (column, bin) and class, map-side first; bins are ranges of
  about as many traces each, the same ones for all regions, with the least and the greatest value in them;
* running sums over the bins give the classes left and right of the threshold between two bins; purity is a convex
  function of the traces and anomalies on the left, so no threshold inside a bin beats the corners of what the
  bin may add. The traces of bins that may hold the best threshold are counted by value;
* so every possible threshold, the midpoint of neighbouring values, is compared (exact splits); the best
  one per (region, column) has the least weighted Gini impurity, with enough traces on either side;
* a node takes the best column of those drawn for it (a hash of seed, tree and node orders the columns; if none
  of those drawn can be split, the next in that order that can); rows move to the regions of the children.

A missing value is above every threshold: it goes right, and is no value of the histogram. Nodes are numbered
like a heap: the children of ``i`` are ``2 i + 1`` and ``2 i + 2``.

Predicates:

* split score of an inner node = P(anomaly | left child) - P(anomaly | right child);
* predicate of a split on ``x <= t``: score >= 0 -> ``[0, t + 1)``, else ``[t + 1, 10^6)``;
* a node's scope is the list of predicates of its ancestors; both children inherit the parent's
  anomalous-side predicate (not the branch taken), as in the source model;
* per last predicate the best-scoring path is kept, then the top ``k`` by ``|score|``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanrules.functions.columns import clean_double, qcol
from spanrules.session import cut_lineage, ship_by_value

ship_by_value(__name__)

UPPER = 10.0 ** 6
MAX_DEPTH = 60  # node numbers are 64 bits
BINS = 1 << 10  # bins of a column, or more of them if they would hold more rows than ROWS_PER_BIN
ROWS_PER_BIN = 1 << 16
ROWS_PER_TASK = 1 << 18
DENSE_BINS = 1 << 21  # bins (32 bytes each) of all regions of a level that a task holds
BROADCAST_BINS = 1 << 17  # bins of a level (56 bytes each) that are broadcast
BROADCAST_BOXES = 1 << 13  # boxes of a level (16 bytes a column and their names) that are broadcast

MEMBER = ["region", "x", "y", "w"]
MEMBERS = "region long, x array<struct<v: double, c: int>>, y int, w long"


def _counts() -> tuple[Column, Column]:
    """Traces and anomalies."""
    return F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("a")


def _key(box: str) -> Column:
    """What tells regions apart: the ends of the box."""
    return F.array_join(F.transform(box, lambda e: F.concat_ws(":", e["lo"], e["hi"])), ";")


def _arrays(batch: pa.RecordBatch, n_cols: int) -> tuple[np.ndarray, np.ndarray]:
    """Values (missing: NaN) and bins of a batch of members, a row each column."""
    flat = batch.column("x").flatten()
    return tuple(np.ascontiguousarray(flat.field(i).to_numpy(zero_copy_only=False).reshape(-1, n_cols).T) for i in (0, 1))


def _routed(batch: pa.RecordBatch, v: np.ndarray, steps: Sequence[Sequence[tuple]]) -> dict[int, np.ndarray]:
    """The rows of the batch in each region after ``steps``, one a level: ``(from, f, t, side, region)``."""
    own = batch.column("region").to_numpy()
    held = {int(r): np.flatnonzero(own == r) for r in np.unique(own)}
    for step in steps:
        parted: dict[tuple, np.ndarray] = {}
        new = {}
        for from_, f, t, side, region in step:
            if from_ in held:
                rows = held[from_]
                if (from_, f, t) not in parted:
                    parted[from_, f, t] = v[f][rows] <= t  # not so for NaN
                left = parted[from_, f, t]
                new[region] = rows[~left] if side else rows[left]
        held = new
    return held


class _Members:
    """The rows of all regions of a level, with a row for every region that a row is in: written ``members`` (``region,
    x, y, w``) and the levels that lead on from there. A task follows them in memory, row by row; only where
    the boxes are too many for that, the rows of a level are written."""

    def __init__(self, written: DataFrame, regions: Sequence[int], n_cols: int, bins: int):
        self.written, self.regions, self.n_cols, self.bins = written, list(regions), n_cols, bins
        self.steps: list[list[tuple]] = []

    def rows(self) -> DataFrame:
        if not self.steps:
            return self.written
        steps, n_cols = self.steps, self.n_cols

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for region, at in _routed(batch, _arrays(batch, n_cols)[0], steps).items():
                    if len(at):
                        part = batch.take(pa.array(at))
                        yield pa.record_batch([pa.array(np.full(len(at), region)), *[part.column(c) for c in MEMBER[1:]]], names=MEMBER)

        return self.written.mapInArrow(run, MEMBERS)

    def values(self) -> DataFrame:
        return (self.rows().select("region", "y", "w", F.posexplode("x").alias("f", "x"))
                .select("region", "f", "x.c", "x.v", "y", "w").where("v IS NOT NULL"))

    def few(self) -> bool:
        """A task can hold all bins of all regions."""
        return len(self.regions) * self.n_cols * self.bins <= DENSE_BINS

    def _cells(self):
        """What yields, of a batch, the columns in turn: the cell ``(region, column, bin)`` of each value with its row."""
        slots, steps, n_cols, bins = {r: i for i, r in enumerate(self.regions)}, self.steps, self.n_cols, self.bins

        def cells(batch: pa.RecordBatch):
            v, c = _arrays(batch, n_cols)
            held = [(slots[r], at) for r, at in _routed(batch, v, steps).items() if r in slots]
            if held:
                at = np.concatenate([a for _, a in held])
                slot = np.repeat(np.array([i for i, _ in held], np.int64), [len(a) for _, a in held])
                for f in range(n_cols):
                    value = v[f][at]
                    known = ~np.isnan(value)
                    rows = at[known]
                    yield (slot[known] * n_cols + f) * bins + c[f][rows].astype(np.int64), value[known], rows

        return cells

    def histogram(self) -> DataFrame:
        """``(region, f, c, w, a, lo, hi)``: traces, anomalies, least and greatest value of each bin."""
        if not self.few():
            return self.values().groupBy("region", "f", "c").agg(*_counts(), F.min("v").alias("lo"), F.max("v").alias("hi"))
        cells, names, n_cols, bins = self._cells(), np.array(self.regions, np.int64), self.n_cols, self.bins

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = len(names) * n_cols * bins
            w, a, lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, np.inf), np.full(n, -np.inf)
            for batch in batches:
                weight = batch.column("w").to_numpy()
                slow = weight * batch.column("y").to_numpy()
                for cell, value, rows in cells(batch):
                    np.add.at(w, cell, weight[rows])
                    np.add.at(a, cell, slow[rows])
                    np.minimum.at(lo, cell, value)
                    np.maximum.at(hi, cell, value)
            at = np.flatnonzero(w)
            yield pa.record_batch([pa.array(x) for x in (
                names[at // (n_cols * bins)], (at // bins % n_cols).astype(np.int32), (at % bins).astype(np.int32), w[at], a[at], lo[at], hi[at])],
                names=["region", "f", "c", "w", "a", "lo", "hi"])

        parts = self.written.mapInArrow(run, "region long, f int, c int, w long, a long, lo double, hi double")
        return parts.groupBy("region", "f", "c").agg(F.sum("w").alias("w"), F.sum("a").alias("a"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def inside(self, bins: DataFrame) -> DataFrame:
        """The columns of ``bins`` with ``v, w, a``: traces and anomalies of each value in these ``(region, f, c)``."""
        n = bins.count()
        if not n:
            return bins.select("*", F.lit(0.0).alias("v"), *[F.lit(0).cast("long").alias(c) for c in ("w", "a")])
        near = F.broadcast(bins) if n <= BROADCAST_BINS else bins
        if not (self.few() and n <= BROADCAST_BINS):
            return self.values().join(near, ["region", "f", "c"]).groupBy(*bins.columns, "v").agg(*_counts())
        cells, names, n_cols, width = self._cells(), np.array(self.regions, np.int64), self.n_cols, self.bins
        slots = {r: i for i, r in enumerate(self.regions)}
        asked = np.array([(slots[b["region"]] * n_cols + b["f"]) * width + b["c"] for b in bins.select("region", "f", "c").collect()], np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = np.zeros(len(names) * n_cols * width, bool)
            wanted[asked] = True
            for batch in batches:
                weight, y = batch.column("w").to_numpy(), batch.column("y").to_numpy()
                for cell, value, rows in cells(batch):
                    there = wanted[cell]
                    at, rows = cell[there], rows[there]
                    yield pa.record_batch([pa.array(x) for x in (
                        names[at // (n_cols * width)], (at // width % n_cols).astype(np.int32), (at % width).astype(np.int32),
                        value[there], y[rows], weight[rows])], names=["region", "f", "c", "v", "y", "w"])

        values = self.written.mapInArrow(run, "region long, f int, c int, v double, y int, w long")
        return values.groupBy("region", "f", "c", "v").agg(*_counts()).join(near, ["region", "f", "c"])

    def step(self, once: DataFrame, n_ways: int) -> None:
        """On to the regions of ``once`` (``region, from, f, t, side``), each by its way."""
        way = once.select("from", "f", "t", "side", "region")
        if sum(map(len, self.steps)) + n_ways <= BROADCAST_BOXES:
            step = [tuple(r) for r in way.collect()]
            self.steps.append(step)
            self.regions = sorted(r[-1] for r in step)
            return
        went = F.when(F.coalesce(F.get("x", F.col("f"))["v"] <= F.col("t"), F.lit(False)), F.lit(0)).otherwise(F.lit(1))
        self.written = cut_lineage(self.rows().withColumnRenamed("region", "from").join(F.broadcast(way) if n_ways <= BROADCAST_BOXES else way, "from")
                                   .where(went == F.col("side")).select(*MEMBER))
        self.steps = []
        # their names only if a task can hold the bins of them
        self.regions = sorted(r[0] for r in way.select("region").collect()) if n_ways * self.n_cols * self.bins <= DENSE_BINS else range(n_ways)


def _binned(rows: DataFrame, n_cols: int) -> tuple[DataFrame, int]:
    """``rows`` as members of region 0, with the values ``x`` as an array of ``(v, c)``: the value and its bin. Any bins that keep the order of
    the values are right, these hold about as many rows each. The rows are small, so they are dealt to all cores by
    their number: each level reads what the tasks of the one before it wrote. Second, the number of bins."""
    n = rows.count()
    bins = max(BINS, n // ROWS_PER_BIN)
    at = [i / bins for i in range(1, bins)]
    cut = rows.agg(*[F.percentile_approx(F.col("x")[i], at, 10 * bins).alias(f"e{i}") for i in range(n_cols)]).first() if n else None
    edges = [np.unique(np.array(cut[f"e{i}"] or [], float)) if n else np.empty(0) for i in range(n_cols)]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            flat = x.flatten()
            v = np.asarray(flat.fill_null(0.0).to_numpy(zero_copy_only=False), float).reshape(-1, n_cols)
            c = np.stack([np.searchsorted(e, v[:, i]) for i, e in enumerate(edges)], axis=1).astype(np.int32)
            pairs = pa.StructArray.from_arrays([flat, pa.array(c.reshape(-1))], names=["v", "c"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n_cols), pairs)
            yield pa.record_batch([pa.array(np.zeros(batch.num_rows, np.int64)), lists, batch.column("y"), batch.column("w")], names=MEMBER)

    parts = max(rows.sparkSession.sparkContext.defaultParallelism, n // ROWS_PER_TASK)
    return cut_lineage(rows.repartition(parts).mapInArrow(code, MEMBERS)), 1 + max(map(len, edges))


def _purity(n: Column, p: Column, nl: Column, pl: Column) -> Column:
    """Of ``n`` traces with ``p`` anomalies, ``nl`` and ``pl`` of them on the left: the larger, the purer the two sides."""
    def share(p: Column, n: Column) -> Column:
        p, q = p.cast("double"), (n - p).cast("double")
        return F.coalesce(F.try_divide(p * p + q * q, n.cast("double")), F.lit(0.0))

    return share(pl, nl) + share(p - pl, n - nl)


def _best_splits(members: _Members, regions: DataFrame, min_leaf: int) -> DataFrame:
    """``(region, f, t, gain, nl, pl)``: the best split of each region and column that leaves ``min_leaf`` traces on
    either side, with the traces and anomalies on its left. ``regions`` has ``region, n, p``."""
    each = Window.partitionBy("region", "f")
    bins = members.histogram()
    n, p, nl, pl = (F.col(c) for c in ("n", "p", "nl", "pl"))
    bins = (bins.join(regions.select("region", "n", "p"), "region")
            .select("*", F.sum("w").over(each.orderBy("c")).alias("nl"), F.sum("a").over(each.orderBy("c")).alias("pl"),
                    F.lead("lo").over(each.orderBy("c")).alias("after")))
    roomy = (nl >= min_leaf) & (n - nl >= min_leaf)
    bins = bins.withColumn("gain", F.when(roomy & F.col("after").isNotNull(), _purity(n, p, nl, pl)))
    # inside a bin: none, or all, of its anomalies on the left, with all, or none, of its other traces
    nl0, pl0, normal = nl - F.col("w"), pl - F.col("a"), F.col("w") - F.col("a")
    corners = [(nl0, pl0), (nl, pl), (nl0 + F.col("a"), pl), (nl0 + normal, pl0)]

    reach = F.greatest(*[_purity(n, p, nc, pc) for nc, pc in corners])
    bins = cut_lineage(bins.withColumn("open", (F.col("lo") < F.col("hi")) & (nl > min_leaf) & (n - nl0 > min_leaf)
                                       & (reach * (1 + 1e-9) >= F.coalesce(F.max("gain").over(each), F.lit(0.0)))))
    inside = bins.where("open").select("region", "f", "c", "n", "p", nl0.alias("nl0"), pl0.alias("pl0"))
    by_value = Window.partitionBy("region", "f", "c").orderBy("v")
    inside = (members.inside(inside)
              .select("region", "f", "n", "p", (F.col("nl0") + F.sum("w").over(by_value)).alias("nl"),
                      (F.col("pl0") + F.sum("a").over(by_value)).alias("pl"), "v", F.lead("v").over(by_value).alias("after"))
              .where(roomy & F.col("after").isNotNull()).withColumn("gain", _purity(n, p, nl, pl)))
    t = (F.col("v") / 2 + F.col("after") / 2).alias("t")
    parts = (bins.where("gain IS NOT NULL").withColumnRenamed("hi", "v").select("region", "f", t, "gain", "nl", "pl")
             .unionByName(inside.select("region", "f", t, "gain", "nl", "pl")))
    best = parts.groupBy("region", "f").agg(F.min_by(F.struct("t", "gain", "nl", "pl"), F.struct((-F.col("gain")).alias("g"), "t")).alias("s"))
    return best.select("region", "f", "s.*")


def _drawn(n_cols: int, seed: int) -> Column:
    """All columns in the order of a node's draw."""
    hashed = F.transform(F.sequence(F.lit(0), F.lit(n_cols - 1)),
                         lambda f: F.struct(F.md5(F.concat_ws(":", F.lit(seed), "tree", "id", f)).alias("h"), f.alias("f")))
    return F.transform(F.array_sort(hashed), lambda x: x["f"])


def grow_forest(traces: DataFrame, target: str, cols: Sequence[str], sla: float,
                num_trees: int = 50, feature_fraction: float = 0.6, leaf_fraction: float = 0.05,
                max_depth: int = MAX_DEPTH, seed: int = 42) -> DataFrame:
    """``(tree, id, left, right, feature, threshold, neg, pos)`` of every node of ``num_trees`` trees, no bootstrap,
    ``feature_fraction`` of the columns per split, leaves of at least ``leaf_fraction`` of the anomalies
    (``target > sla``). A leaf has -1 for its children and feature. A table without rows gives no node.
    """
    spark = traces.sparkSession
    slow = F.when(clean_double(qcol(target)) > F.lit(float(sla)), F.lit(1)).otherwise(F.lit(0))
    rows = cut_lineage(traces.select(F.array(*[clean_double(qcol(c)) for c in cols]).alias("x"), slow.alias("y"))
                       .groupBy("x", "y").agg(F.count(F.lit(1)).alias("w")))
    rows, bins = _binned(rows, len(cols))
    all_, anomalies = rows.agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.sum(F.col("w") * F.col("y")), F.lit(0))).first()
    min_leaf = max(1, int(anomalies * leaf_fraction))
    drawn = max(1, int(feature_fraction * len(cols)))
    inf, none = F.lit(float("inf")), F.lit(-1)
    whole = F.array(*[F.struct((-inf).alias("lo"), inf.alias("hi"))] * len(cols))
    # both classes and room for two leaves: only such regions keep their rows
    splittable = (F.col("p") > 0) & (F.col("p") < F.col("n")) & (F.col("n") >= 2 * min_leaf)
    root = spark.range(1).select(whole.alias("box"), F.lit(all_).cast("long").alias("n"), F.lit(anomalies).cast("long").alias("p")).where("n > 0")
    regions = root.withColumn("region", F.lit(0).cast("long"))
    nodes = cut_lineage(regions.select(F.explode(F.sequence(F.lit(0), F.lit(num_trees - 1))).alias("tree"), F.lit(0).cast("long").alias("id"), "region", "n", "p"))
    regions = cut_lineage(regions.where(splittable))
    members = _Members(rows, [r[0] for r in regions.select("region").collect()], len(cols), bins)  # the root, or nothing
    out = []
    for depth in range(min(max_depth, MAX_DEPTH) + 1):
        best = cut_lineage(_best_splits(members, regions, min_leaf))
        # columns drawn compete, the others come one after the other
        place = F.array_position("draw", F.col("f")) - 1
        turn = F.when(place < drawn, F.lit(0)).otherwise(place).cast("int")
        found = (nodes.withColumn("draw", _drawn(len(cols), seed)).join(best, "region").withColumn("turn", turn).groupBy("tree", "id")
                 .agg(F.min_by(F.struct("f", "t", "nl", "pl"), F.struct("turn", (-F.col("gain")).alias("g"), "f")).alias("s")))
        inner = F.lit(depth < min(max_depth, MAX_DEPTH))
        level = cut_lineage(nodes.join(found, ["tree", "id"], "left")
                            .select("tree", "id", "region", "n", "p", *[F.when(inner, F.col(f"s.{c}")).alias(c) for c in ("f", "t", "nl", "pl")]))
        leaf = F.col("f").isNull()
        out.append(level.select("tree", "id", F.when(leaf, none).otherwise(2 * F.col("id") + 1).cast("long").alias("left"),
                                F.when(leaf, none).otherwise(2 * F.col("id") + 2).cast("long").alias("right"),
                                F.coalesce("f", none).cast("int").alias("feature"), F.col("t").alias("threshold"),
                                (F.col("n") - F.col("p")).alias("neg"), F.col("p").alias("pos")))
        splits = level.where("f IS NOT NULL").select("region", "f", "t", "nl", "pl").distinct()
        # every split once, with the boxes of its two sides
        right = F.transform("box", lambda e, i: F.when(i == F.col("f"), F.struct(F.col("t").alias("lo"), e["hi"].alias("hi"))).otherwise(e))
        left = F.transform("box", lambda e, i: F.when(i == F.col("f"), F.struct(e["lo"].alias("lo"), F.col("t").alias("hi"))).otherwise(e))
        sides = F.array(F.struct(F.lit(0).alias("side"), left.alias("box"), F.col("nl").alias("n"), F.col("pl").alias("p")),
                        F.struct(F.lit(1).alias("side"), right.alias("box"), (F.col("n") - F.col("nl")).alias("n"), (F.col("p") - F.col("pl")).alias("p")))
        ways = regions.join(splits, "region").select(F.col("region").alias("from"), "f", "t", F.inline(sides))
        ways = cut_lineage(ways.withColumn("key", _key("box")))
        n_ways = ways.count()
        if not n_ways:
            break
        numbers = cut_lineage(ways.select("key").distinct().withColumn("region", F.monotonically_increasing_id()))
        ways = cut_lineage(ways.join(numbers, "key").drop("key"))
        sent = F.broadcast(ways) if n_ways <= BROADCAST_BOXES else ways
        nodes = cut_lineage(level.where("f IS NOT NULL").select("tree", "id", F.col("region").alias("from"), "f", "t").join(sent, ["from", "f", "t"])
                            .select("tree", (2 * F.col("id") + 1 + F.col("side")).alias("id"), "region", "n", "p"))
        # a region reached on several ways is one region; its rows come by one of them
        once = ways.where(splittable).groupBy("region").agg(F.min_by(F.struct("from", "f", "t", "side", "box", "n", "p"), F.struct("from", "f", "t")).alias("way"))
        once = cut_lineage(once.select("region", "way.*"))
        regions = once.select("region", "box", "n", "p")
        members.step(once, n_ways)
    table = out[0]
    for more in out[1:]:
        table = table.unionByName(more)
    return table


def split_predicates(nodes: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per inner node: its score and its predicate ``(col, lo, hi)`` on the anomalous side."""
    inner = nodes.filter(F.col("left") >= 0)
    kid = nodes.select("tree", "id", (F.col("pos") / (F.col("pos") + F.col("neg"))).alias("p"))
    l, r = kid.alias("l"), kid.alias("r")
    s = (inner.alias("n")
              .join(l, (F.col("n.tree") == F.col("l.tree")) & (F.col("n.left") == F.col("l.id")))
              .join(r, (F.col("n.tree") == F.col("r.tree")) & (F.col("n.right") == F.col("r.id")))
              .select(F.col("n.tree").alias("tree"), F.col("n.id").alias("id"),
                      F.col("n.left").alias("left"), F.col("n.right").alias("right"),
                      F.col("n.feature").alias("feature"), F.col("n.threshold").alias("threshold"),
                      (F.col("l.p") - F.col("r.p")).alias("score")))
    names = F.array(*[F.lit(c) for c in cols])
    t1 = F.col("threshold") + F.lit(1.0)
    pred = F.struct(names[F.col("feature")].alias("col"),
                    F.when(F.col("score") >= 0, F.lit(0.0)).otherwise(t1).alias("lo"),
                    F.when(F.col("score") >= 0, t1).otherwise(F.lit(UPPER)).alias("hi"))
    return s.withColumn("pred", pred)


def scoped_predicates(splits: DataFrame, first_tree_only: bool = False) -> DataFrame:
    """``(tree, id, path array<pred>, score)`` for every inner node, root first. A node's ancestors follow from
    its number, so all paths come from one join."""
    if first_tree_only:
        splits = splits.filter(F.col("tree") == 0)
    splits = cut_lineage(splits)
    depth = F.floor(F.log2(F.col("id") + 1) + 1e-9).cast("int")
    up = F.transform(F.sequence(F.lit(0), depth), lambda j: F.struct(j.alias("up"), (F.call_function("shiftright", F.col("id") + 1, j) - 1).alias("over")))
    asked = splits.select("tree", "id", "score", F.inline(up))
    held = splits.select("tree", F.col("id").alias("over"), "pred")
    path = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("down"), "pred"))), lambda x: x["pred"])
    return asked.join(held, ["tree", "over"]).groupBy("tree", "id", "score").agg(path.alias("path")).select("tree", "id", "path", "score")


def explain(scoped: DataFrame, k: int = 10) -> DataFrame:
    """Best path per last predicate, then the top ``k`` by ``|score|``: ``(rank, path, score)``."""
    s = scoped.select("tree", "id", "path", F.abs("score").alias("score"),
                      F.element_at("path", -1).alias("last"))
    best = (s.groupBy("last").agg(F.min_by(F.struct("path", "score", "tree", "id"),
                                           F.struct((-F.col("score")).alias("s"), F.col("tree").alias("t"),
                                                    F.col("id").alias("i"))).alias("b"))
             .select("b.*"))
    top = best.orderBy(F.col("score").desc(), "tree", "id").limit(k)
    text = F.array_join(F.transform("path", lambda p: F.format_string(
        "%s in [%s, %s)", p["col"], p["lo"], p["hi"])), " AND ")
    w = Window.orderBy(F.col("score").desc(), "tree", "id")  # over the k rows kept
    return top.select(F.row_number().over(w).alias("rank"), text.alias("predicate"),
                      F.element_at("path", -1)["col"].alias("col"),
                      F.element_at("path", -1)["lo"].alias("lo"),
                      F.element_at("path", -1)["hi"].alias("hi"), "score", "tree", "id")


def forest_predicates(traces: DataFrame, target: str, cols: Sequence[str], sla: float, k: int = 10,
                      trees: str = "all", **forest_args) -> DataFrame:
    nodes = cut_lineage(grow_forest(traces, target, cols, sla, **forest_args))
    scoped = scoped_predicates(split_predicates(nodes, cols), first_tree_only=(trees == "first"))
    return explain(scoped, k)
