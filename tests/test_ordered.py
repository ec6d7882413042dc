"""Running values, order statistics and modes over several ranges, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanrules.operators import meanshift, ordered
from spanrules.operators.thresholds import quantile_thresholds, select_quantiles


@pytest.fixture()
def small_ranges(monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_RANGE", 40)


def test_running_sums_and_last_values(spark, small_ranges):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "a", "b", None]), i, rnd.randint(0, 9), rnd.choice([None, float(i)])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, k int, n int, x double").repartition(5)
    got = {r["k"]: (r["s"], r["l"]) for r in ordered.running(df, "g", ["k"], {"s": "n"}, {"l": "x"}).collect()}
    for g in ("a", "b", None):
        total, last = 0, None
        for h, k, n, x in rows:
            if h == g:
                total, last = total + n, x if x is not None else last
                assert got[k] == (total, last)


def test_positions_and_neighbours_with_ties(spark, small_ranges):
    rows = [("a", 1.0)] * 150 + [("a", float(i)) for i in range(2, 60)] + [("b", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = ordered.positions(df, "g", ["v"]).collect()
    assert sorted(r["pos"] for r in got if r["g"] == "a") == list(range(1, 209))
    assert all(a["v"] <= b["v"] for a, b in zip(*(lambda x: (x, x[1:]))(sorted((r for r in got if r["g"] == "a"), key=lambda r: r["pos"]))))
    near = ordered.neighbours(df, "g", ["v"], F.col("v"), "prev", "next").collect()
    assert sum(r["prev"] is None for r in near) == 2 and sum(r["next"] is None for r in near) == 2
    assert {(r["prev"], r["v"], r["next"]) for r in near if r["v"] == 30.0} == {(29.0, 30.0, 31.0)}


def test_running_of_nothing(spark):
    df = spark.createDataFrame([], "g string, k int")
    assert ordered.positions(df, "g", ["k"]).count() == 0


def _kth(values, k):
    x = np.asarray(values)
    return np.sort(np.abs(x[:, None] - x[None, :]), axis=1)[:, k - 1]


def test_bandwidth_of_unrounded_values_over_many_ranges(spark, small_ranges):
    rng = np.random.default_rng(11)
    cols = {"p": rng.lognormal(3, 1, 400), "q": np.concatenate([np.full(200, 7.25), rng.normal(0, 1, 100)]), "r": np.array([4.0])}
    rows = [(c, float(v)) for c, x in cols.items() for v in x]
    hist = spark.createDataFrame(rows, "col string, v double").groupBy("col", "v").agg(F.count(F.lit(1)).alias("w"))
    for q in (0.1, 0.004):
        got = {r["col"]: r for r in meanshift.bandwidth(hist, q).collect()}
        for c, x in cols.items():
            k = max(1, int(len(x) * q))
            assert got[c]["k"] == k and got[c]["n"] == len(x)
            assert got[c]["bandwidth"] == pytest.approx(_kth(x, k).mean(), rel=1e-12)


def test_every_kth_distance(spark, small_ranges):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 5, 250) * 4) / 4
    v, w = np.unique(x, return_counts=True)
    hist = spark.createDataFrame([("c", float(a), int(b)) for a, b in zip(v, w)], "col string, v double, w long")
    for k in (2, 9):
        sizes = spark.createDataFrame([("c", len(x), k)], "col string, n long, k long")
        got = {r["v"]: r["d"] for r in meanshift.kth_distance(hist, sizes).collect()}
        want = {float(a): float(d) for a, d in zip(x, _kth(x, k))}
        assert got == want


def _greedy(found, bw):
    best = {}
    for m, i in found:
        best[m] = max(i, best.get(m, 0))
    kept, out = [], []
    for rank, (m, i) in enumerate(sorted(best.items(), key=lambda t: (-t[1], t[0]))):
        ok = all(abs(m - x) > bw for x in kept)
        kept += [m] if ok else []
        out.append((m, i, ok, rank))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_modes_by_fixed_point_are_the_greedy_ones(spark, small_ranges, seed):
    rng = np.random.default_rng(seed)
    data = {"x": (rng.uniform(-40, 40, 150).round(2), 2.0), "y": (np.arange(0, 30, 0.75), 1.0), "z": (rng.integers(0, 9, 60).astype(float), 1.0)}
    inten = {c: rng.integers(1, 20, len(m)) for c, (m, _) in data.items()}
    inten["y"] = np.arange(len(data["y"][0]))  # a chain: each beats the one before
    rows = [(c, float(m), int(i)) for c, (ms, _) in data.items() for m, i in zip(ms, inten[c])]
    bw = spark.createDataFrame([(c, b) for c, (_, b) in data.items()], "col string, bandwidth double")
    got = meanshift.modes(spark.createDataFrame(rows, "col string, mean double, intensity long"), bw).collect()
    for c, (ms, b) in data.items():
        want = _greedy([(float(m), int(i)) for m, i in zip(ms, inten[c])], b)
        assert sorted((r["mean"], r["intensity"], r["kept"], r["rank"]) for r in got if r["col"] == c) == sorted(want)


def test_no_seeds_no_modes(spark):
    none = spark.createDataFrame([], "col string, mean double, intensity long")
    bw = spark.createDataFrame([("x", 1.0)], "col string, bandwidth double")
    assert meanshift.modes(none, bw).count() == 0


def test_quantiles_of_odd_columns(spark):
    inf = float("inf")
    data = {"a": [1.0, 2.0, None, float("nan"), 3.0, 4.0], "b": [5e-324, 0.0, -5e-324, 1.7e308, -1.7e308, inf],
            "c": [None] * 6, "d": [7.0] * 6, "e": [-inf, 0.0, 1.0, 1.0 + 1e-15, 1e-300, inf]}
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"{c} double" for c in data))
    qs = [0.0, 0.2, 0.25, 0.5, 0.75, 0.9, 1.0]
    got, ends = select_quantiles(df, {c: qs for c in data})
    for c, values in data.items():
        x = sorted(v for v in values if v is not None and not math.isnan(v))
        assert got[c] == [x[max(1, math.ceil(q * len(x))) - 1] if x else None for q in qs]
        assert ends[c] == ((x[0], x[-1]) if x else (None, None))


def test_quantiles_of_skewed_values(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.lognormal(0, 8, 3000), np.full(1500, 1.0)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(6)
    qs = [0.01, 0.1, 1 / 3, 0.5, 0.66, 0.99, 0.999]
    s = np.sort(x)
    got, _ = select_quantiles(df, {"x": qs})
    assert got["x"] == [s[max(1, math.ceil(q * len(s))) - 1] for q in qs]


def test_thresholds_of_an_empty_table(spark):
    df = spark.createDataFrame([], "x double")
    assert quantile_thresholds(df, ["x"], [0.5]) == {"x": []}


def _dominates(a, b):
    return a[0] >= b[0] and a[1] >= b[1] and a[2] <= b[2] and a != b


def _points(kind, n, seed=4):
    rng = np.random.default_rng(seed)
    if kind == "grid":  # many ties in every objective
        return [tuple(map(float, x)) for x in rng.integers(0, 6, (n, 3))]
    if kind == "same precision":
        return [(0.5, float(a), float(b)) for a, b in rng.integers(0, 40, (n, 2))]
    if kind == "surface":  # nearly all of them are in the front
        a, b = rng.random(n), rng.random(n)
        return [(float(x), float(y), float(x + y)) for x, y in zip(a, b)]
    return [(float(x), float(y), float(z)) for x, y, z in rng.random((n, 3))] + [(0.0, 0.0, float("inf"))] * 5


@pytest.mark.parametrize("kind", ["grid", "same precision", "surface", "cloud"])
@pytest.mark.parametrize("block", [50_000, 20])
def test_front_of_many_blocks(spark, monkeypatch, small_ranges, kind, block):
    from spanrules.operators import pareto
    monkeypatch.setattr(pareto, "BLOCK_POINTS", block)
    pts = _points(kind, 220)
    df = spark.createDataFrame([(f"k{i:03d}", *p) for i, p in enumerate(pts)], "set_id string, fit_p double, fit_r double, fit_d double")
    got = {r["set_id"] for r in pareto.pareto_front(df.repartition(3)).collect()}
    first = {}
    for i, p in enumerate(pts):
        first.setdefault(p, f"k{i:03d}")
    assert got == {k for p, k in first.items() if not any(_dominates(q, p) for q in first)}
    if kind == "surface":
        assert len(got) > 150


def test_what_a_front_dominates(spark, monkeypatch):
    from spanrules.operators import pareto
    monkeypatch.setattr(pareto, "BLOCK_POINTS", 15)
    front, pts = _points("surface", 60), _points("grid", 40) + _points("cloud", 150, 9) + _points("surface", 20)
    frame = lambda rows: spark.createDataFrame([(f"k{i:03d}", *p) for i, p in enumerate(rows)], "set_id string, fit_p double, fit_r double, fit_d double")
    got = {r["set_id"] for r in pareto.dominated(frame(pts), frame(front)).collect()}
    # a point that is itself in the front is left alone
    assert got == {f"k{i:03d}" for i, p in enumerate(pts) if p not in front and any(_dominates(q, p) for q in front)}


def test_crowding_over_many_ranges(spark, small_ranges):
    from spanrules.operators import pareto
    pts = sorted(set(_points("surface", 90)))
    df = spark.createDataFrame([(f"k{i:03d}", *p) for i, p in enumerate(pts)], "set_id string, fit_p double, fit_r double, fit_d double")
    got = {r["set_id"]: r["crowding"] for r in pareto.crowding_distance(df).collect()}
    want = dict.fromkeys(got, 0.0)
    for axis, sign in ((0, 1), (1, 1), (2, -1)):
        order = sorted(range(len(pts)), key=lambda i: (sign * pts[i][axis], f"k{i:03d}"))
        v = [sign * pts[i][axis] for i in order]
        for n, i in enumerate(order):
            want[f"k{i:03d}"] += float("inf") if n in (0, len(order) - 1) else (v[n + 1] - v[n - 1]) / (3 * (v[-1] - v[0]))
    assert got == {k: pytest.approx(x) for k, x in want.items()}
