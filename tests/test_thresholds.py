"""Quantile and mean-shift thresholds, bandwidth against brute force, forest predicates."""

import random

import numpy as np
import pytest

from spanrules.operators import forest, meanshift
from spanrules.operators.thresholds import exact_quantiles, quantile_thresholds


@pytest.fixture(scope="module")
def traces(spark):
    rnd = random.Random(3)
    rows = []
    for _ in range(600):
        mode = rnd.choice([10, 50, 90])
        rows.append((float(mode + rnd.randint(-4, 4)), float(rnd.randint(0, 5)), 7.0,
                     float(mode * 3 + rnd.randint(0, 20))))
    return spark.createDataFrame(rows, "x double, z double, k double, y double").cache()


def test_quantile_thresholds_end_with_max_plus_one(traces):
    th = quantile_thresholds(traces, ["x", "k"], [0.0, 0.5])
    xs = sorted(r[0] for r in traces.select("x").collect())
    assert th["x"][-1] == xs[-1] + 1 and th["x"][0] == xs[0]
    assert th["x"] == sorted(set(th["x"]))
    assert th["k"] == [7.0, 8.0]
    with_min = quantile_thresholds(traces, ["x"], [0.5], with_min=True)
    assert with_min["x"][0] == xs[0]


def test_exact_quantile_is_discrete(traces):
    xs = sorted(r[0] for r in traces.select("x").collect())
    q = exact_quantiles(traces, "x", [0.5])[0]
    assert q in xs
    assert sum(1 for v in xs if v <= q) >= len(xs) / 2


def _brute_bandwidth(values, quantile=0.1):
    x = np.asarray(values, dtype=float)
    k = max(1, int(len(x) * quantile))
    d = np.abs(x[:, None] - x[None, :])
    return float(np.sort(d, axis=1)[:, k - 1].mean())


def test_bandwidth_exact(traces):
    hist = meanshift.value_histogram(traces, ["x", "z"])
    got = {r["col"]: r["bandwidth"] for r in meanshift.bandwidth(hist).collect()}
    for c in ("x", "z"):
        vals = [r[0] for r in traces.select(c).collect()]
        assert got[c] == pytest.approx(_brute_bandwidth(vals), rel=1e-12)


def _brute_meanshift(values, bw, max_iter=300):
    """Flat-kernel mean-shift with binned seeds, point by point (test reference)."""
    x = np.asarray(values, dtype=float)
    bins = {}
    for v in x:
        b = np.round(v / bw)
        bins[b] = bins.get(b, 0) + 1
    seeds = [b * bw for b in sorted(bins)]
    if len(seeds) == len(x):
        seeds = sorted(set(x))
    found = {}
    for m in seeds:
        it = 0
        while True:
            inside = x[np.abs(x - m) <= bw]
            if len(inside) == 0:
                break
            new = inside.mean()
            if abs(new - m) < 1e-3 * bw or it == max_iter:
                found[new] = len(inside)
                break
            m, it = new, it + 1
    order = sorted(found.items(), key=lambda t: (-t[1], t[0]))
    centres = []
    for c, _ in order:
        if all(abs(c - k) > bw for k in centres):
            centres.append(c)
    label = {v: min(centres, key=lambda c: abs(v - c)) for v in set(x)}
    firsts = {}
    for v in x:
        firsts[label[v]] = min(v, firsts.get(label[v], v))
    return sorted(set(firsts.values()) | {x.max() + 1})


def test_meanshift_thresholds(traces):
    th = meanshift.meanshift_thresholds(traces, ["x", "k"])
    xs = [r[0] for r in traces.select("x").collect()]
    assert th["k"] == [7.0, 8.0]                      # constant column
    bw = _brute_bandwidth(xs)
    assert th["x"] == pytest.approx(_brute_meanshift(xs, bw))
    assert th["x"][0] == min(xs) and th["x"][-1] == max(xs) + 1


def test_meanshift_zero_bandwidth_falls_back(traces):
    th = meanshift.meanshift_thresholds(traces, ["x"], bw_value=0.0)
    xs = sorted(r[0] for r in traces.select("x").collect())
    assert th["x"] == [xs[0], xs[-1] + 1]


def test_forest_predicates(traces):
    got = forest.forest_predicates(traces, "y", ["x", "z"], sla=150.0, num_trees=5, max_depth=6).collect()
    assert 0 < len(got) <= 10
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1))
    assert all(0 <= r["score"] <= 1 for r in got)
    assert got[0]["col"] == "x"
    lasts = [(r["col"], r["lo"], r["hi"]) for r in got]
    assert len(lasts) == len(set(lasts))


def test_forest_first_tree_only(traces):
    got = forest.forest_predicates(traces, "y", ["x", "z"], sla=150.0, num_trees=3, max_depth=4,
                                   trees="first").collect()
    assert got and all(r["tree"] == 0 for r in got)


def test_forest_extraction_from_a_known_tree(spark):
    """Inherited scope is the predicate of the anomalous side, whichever child follows."""
    from spanrules.operators import forest

    nodes = spark.createDataFrame(
        [(0, 0, 1, 2, 0, 4.0, 6.0, 4.0), (0, 1, 3, 4, 1, 9.0, 5.0, 1.0), (0, 2, -1, -1, -1, None, 1.0, 3.0),
         (0, 3, -1, -1, -1, None, 1.0, 1.0), (0, 4, -1, -1, -1, None, 4.0, 0.0),
         (1, 0, 1, 2, 0, 4.0, 5.0, 5.0), (1, 1, -1, -1, -1, None, 4.0, 1.0), (1, 2, -1, -1, -1, None, 1.0, 4.0)],
        "tree int, id int, left int, right int, feature int, threshold double, neg double, pos double")
    splits = {(r["tree"], r["id"]): r for r in forest.split_predicates(nodes, ["u", "v"]).collect()}
    assert splits[0, 0]["score"] == pytest.approx(1 / 6 - 3 / 4) and tuple(splits[0, 0]["pred"])[:2] == ("u", 5.0)
    assert splits[0, 1]["score"] == pytest.approx(1 / 2) and tuple(splits[0, 1]["pred"]) == ("v", 0.0, 10.0)
    scoped = forest.scoped_predicates(forest.split_predicates(nodes, ["u", "v"]))
    paths = {(r["tree"], r["id"]): [p["col"] for p in r["path"]] for r in scoped.collect()}
    assert paths == {(0, 0): ["u"], (0, 1): ["u", "v"], (1, 0): ["u"]}
    top = forest.explain(scoped, k=2).orderBy("rank").collect()
    # the same last predicate counts once, with its better score: 0.6 of the second tree
    assert [(r["col"], r["tree"], r["rank"]) for r in top] == [("u", 1, 1), ("v", 0, 2)]
    assert top[0]["score"] == pytest.approx(0.6) and top[1]["score"] == pytest.approx(0.5)
    assert forest.explain(scoped, k=1).count() == 1


def _grow(x, y, w_min, drawn, tree, seed):
    """One tree, node by node (test reference): ``{id: (feature, threshold, neg, pos)}``."""
    import hashlib
    out, todo = {}, [(0, np.arange(len(y)))]
    while todo:
        i, rows = todo.pop()
        n, p = len(rows), int(y[rows].sum())
        best = []
        for f in range(x.shape[1]):
            v = x[rows, f]
            known = np.unique(v[~np.isnan(v)])
            for a, b in zip(known, known[1:]):
                left = v <= a
                nl, pl = int(left.sum()), int(y[rows][left].sum())
                if nl >= w_min and n - nl >= w_min:
                    gain = (pl**2 + (nl - pl)**2) / nl + ((p - pl)**2 + (n - nl - p + pl)**2) / (n - nl)
                    best.append((f, -gain, a / 2 + b / 2))
        order = sorted(range(x.shape[1]), key=lambda f: hashlib.md5(f"{seed}:{tree}:{i}:{f}".encode()).hexdigest())
        turn = {f: 0 if order.index(f) < drawn else order.index(f) for f in order}
        pick = min(((turn[f], g, f, t) for f, g, t in best), default=None) if 0 < p < n else None
        out[i] = (pick[2] if pick else -1, pick[3] if pick else None, n - p, p)
        if pick:
            left = x[rows, pick[2]] <= pick[3]
            todo += [(2 * i + 1, rows[left]), (2 * i + 2, rows[~left])]
    return out


@pytest.mark.parametrize("ranges", [1 << 20, 30])
def test_trees_are_those_grown_node_by_node(spark, monkeypatch, ranges):
    from spanrules.operators import ordered
    monkeypatch.setattr(ordered, "ROWS_PER_RANGE", ranges)
    rng = np.random.default_rng(6)
    x = rng.integers(0, 12, (220, 3)).astype(float)
    x[rng.random(x.shape) < 0.08] = np.nan
    x[:, 2] = np.where(rng.random(220) < 0.5, 0.0, x[:, 2])
    y = ((np.nan_to_num(x[:, 0], nan=20) > 6) ^ (rng.random(220) < 0.15)).astype(int)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    got = forest.grow_forest(df, "y", ["a", "b", "c"], 0.5, num_trees=3, feature_fraction=0.7, max_depth=60 if ranges > 30 else 2).collect()
    least = max(1, int(y.sum() * 0.05))
    for tree in range(3):
        mine = {r["id"]: (r["feature"], r["threshold"], r["neg"], r["pos"]) for r in got if r["tree"] == tree}
        want = _grow(x, y, least, 2, tree, 42)
        if ranges > 30:
            assert mine == want
        else:  # cut at depth 2
            assert all(mine[i][2:] == want[i][2:] for i in mine) and max(mine) <= 6
    assert all(r["left"] == (-1 if r["feature"] < 0 else 2 * r["id"] + 1) for r in got)


def test_forest_of_one_class_and_of_nothing(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 6.0)], "a double, y double")
    (r,) = forest.grow_forest(df, "y", ["a"], 1.0, num_trees=1).collect()
    assert (r["id"], r["left"], r["neg"], r["pos"]) == (0, -1, 0, 2)
    assert forest.grow_forest(df.limit(0), "y", ["a"], 1.0, num_trees=2).count() == 0
    assert forest.forest_predicates(df, "y", ["a"], 1.0, num_trees=1).count() == 0


@pytest.mark.parametrize("held, ways", [(1 << 21, 1 << 13), (1 << 21, 2), (0, 1 << 13), (0, 2)])
def test_a_forest_writes_bins_not_every_value_of_every_region(spark, monkeypatch, held, ways):
    """What a level writes does not grow with the distinct values of its regions, and the trees are the exact ones,
    whether a task holds the bins and follows the boxes or not."""
    monkeypatch.setattr(forest, "BINS", 16, raising=False)
    monkeypatch.setattr(forest, "DENSE_BINS", held, raising=False)
    monkeypatch.setattr(forest, "BROADCAST_BOXES", ways)
    rng = np.random.default_rng(7)
    x = rng.random((600, 3)).round(4)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:200, 1] = 0.25
    y = ((np.nan_to_num(x[:, 0], nan=2) > 0.6) ^ (rng.random(600) < 0.1)).astype(int)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    written, cut = [], forest.cut_lineage

    def counted(table):
        out = cut(table)
        if "f" in out.columns and "from" not in out.columns and "tree" not in out.columns:
            written.append((out.count(), out.select("region").distinct().count()))
        return out

    monkeypatch.setattr(forest, "cut_lineage", counted)
    got = forest.grow_forest(df, "y", ["a", "b", "c"], 0.5, num_trees=2, feature_fraction=0.7, leaf_fraction=0.15).collect()
    assert written and all(n <= regions * 3 * 17 for n, regions in written)
    for tree in range(2):
        mine = {r["id"]: (r["feature"], r["threshold"], r["neg"], r["pos"]) for r in got if r["tree"] == tree}
        assert mine == _grow(x, y, int(y.sum() * 0.15), 2, tree, 42)
