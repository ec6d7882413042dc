"""Searches, Pareto selection and segmentation: exactness against enumeration, invariants."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from spanrules.operators import cube as cube_ops
from spanrules.operators import pareto, scoring, search, segment
from spanrules.operators.cube import Space
from spanrules.operators.space import bin_feature_list, rules_up_to
from spanrules.operators.thresholds import quantile_thresholds

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(7)
    rows = []
    for _ in range(500):
        a, b, c = rnd.randint(0, 40), rnd.randint(0, 40), rnd.randint(0, 40)
        y = float(a + (b if b > 20 else 0) + rnd.randint(0, 10))
        rows.append((float(a), float(b), float(c), y))
    df = spark.createDataFrame(rows, "a double, b double, c double, y double").cache()
    th = quantile_thresholds(df, COLS, [0.0, 0.25, 0.5, 0.75])
    space = Space(tuple(COLS), th, "y", (40.0, 100.0))
    return df, space, cube_ops.bucket_cube(df, space).cache()


def _best_by_enumeration(spark, cube, conds, depth, intervals=((0, 1),)):
    scored = scoring.score_rules(cube, rules_up_to(spark, conds, depth), intervals).collect()
    best = {}
    for r in scored:
        key = (r["j"], r["i"])
        cand = (-r["fmeasure"], len(r["rule"]), r["rule_id"])
        if key not in best or cand < best[key]:
            best[key] = cand
    return best


def test_bin_features():
    space = Space(("u", "v", "w"), {"u": [3.5, 7.0], "v": [1.0, 2.0, 9.0, 12.0], "w": [4.0]}, "y", (0, 1))
    assert bin_feature_list(space) == [(0, 0, 1), (1, 0, 1), (1, 1, 2), (1, 2, 3)]


def test_branch_and_bound_is_exact(spark, data):
    _, space, cube = data
    got = search.branch_and_bound(cube, space).collect()[0]
    want = _best_by_enumeration(spark, cube, bin_feature_list(space), len(COLS))[(0, 1)]
    assert (-got["fmeasure"], len(got["rule"]), got["rule_id"]) == want
    assert 0 <= got["precision"] <= 1 and 0 <= got["recall"] <= 1


def test_best_rule_is_exact(spark, data):
    _, space, cube = data
    for depth in (2, None):
        got = search.best_rule(cube, space, depth=depth).collect()[0]
        want = _best_by_enumeration(spark, cube, search.usable_conditions(space), depth or len(COLS))[(0, 1)]
        assert (-got["fmeasure"], len(got["rule"]), got["rule_id"]) == want


def test_beam_rule_ends_at_the_best_rule(spark, data):
    _, space, cube = data
    got = search.beam_rule(cube, space).collect()[0]
    want = search.best_rule(cube, space).collect()[0]
    assert (got["rule_id"], got["fmeasure"]) == (want["rule_id"], want["fmeasure"])


def test_searches_without_usable_conditions(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0), (5.0, 3.0)], "a double, y double")
    space = Space(("a",), {"a": [5.0, 6.0]}, "y", (1.5, 3.0))
    cube = cube_ops.bucket_cube(df, space)
    for found in (search.beam_rule(cube, space), search.best_rule(cube, space)):
        (r,) = found.collect()
        assert (r["rule_id"], r["tp"], r["fp"]) == ("", 2, 1)
    # a column of two thresholds still gives its one condition to rule sets
    front = search.beam_ruleset(cube, space).collect()
    assert {r["set_id"] for r in front} == {"0:0:1"}


def test_sets_recombine_in_either_order(spark):
    sets = spark.createDataFrame(
        [([[{"c": 0, "lo": 0, "hi": 1}], [{"c": 0, "lo": 1, "hi": 2}]],), ([[{"c": 1, "lo": 0, "hi": 1}]],)],
        "rules array<array<struct<c:int,lo:int,hi:int>>>")
    got = {r["set_id"] for r in search.recombine_sets(search.canonical_sets(sets)).collect()}
    assert {"0:0:1", "1:0:1", "0:0:1|1:0:1", "0:1:2", "0:1:2|1:0:1", "0:0:1|0:1:2"} >= got
    assert {"0:0:1", "1:0:1"} <= got  # either set comes first


def test_beam_rule_beats_single_conditions(spark, data):
    _, space, cube = data
    got = search.beam_rule(cube, space, width=5).collect()[0]
    singles = _best_by_enumeration(spark, cube, search.usable_conditions(space), 1)[(0, 1)]
    assert got["fmeasure"] >= -singles[0] - 1e-12
    nth = {p: len(space.thresholds[c]) for p, c in enumerate(COLS)}
    for x in got["rule"]:
        assert 0 <= x["lo"] < x["hi"] < nth[x["c"]]
        assert not (x["lo"] == 0 and x["hi"] == nth[x["c"]] - 1)


def test_rule_neighbours_moves(spark, data):
    _, space, _ = data
    seed = rules_up_to(spark, [(0, 1, 2)], 1, include_empty=False)
    nb = search.rule_neighbours(seed, space).collect()
    moves = {r["move"] for r in nb}
    assert moves == {"add", "remove", "modify"}
    keys = {r["rule_id"] for r in nb}
    assert "" in keys and "0:1:2" not in keys
    for r in nb:
        cs = [x["c"] for x in r["rule"]]
        assert cs == sorted(set(cs))
        for x in r["rule"]:
            assert x["lo"] < x["hi"]


def test_ruleset_neighbours_legal(spark, data):
    _, space, _ = data
    seeds = search.single_condition_sets(spark, [(0, 0, 3)])
    nb = search.ruleset_neighbours(seeds, space).collect()
    moves = {r["move"] for r in nb}
    assert {"add_rule", "split", "complement", "add_cond"} <= moves
    for r in nb:
        assert len(r["rules"]) >= 1
        for rule in r["rules"]:
            assert len(rule) >= 1
            for x in rule:
                assert x["lo"] < x["hi"]
    split = [r for r in nb if r["move"] == "split"]
    assert {r["set_id"] for r in split} == {"0:0:1|0:1:3", "0:0:2|0:2:3"}


def test_pareto_front_non_dominated(spark, data):
    _, space, cube = data
    sets = search.single_condition_sets(spark, search.usable_conditions(space))
    m = scoring.ruleset_metrics(cube, sets).cache()
    front = pareto.pareto_front(m).collect()
    allp = m.select("fit_p", "fit_r", "fit_d").collect()
    assert front
    for f in front:
        for o in allp:
            dominated = (o[0] >= f["fit_p"] and o[1] >= f["fit_r"] and o[2] <= f["fit_d"]
                         and (o[0] > f["fit_p"] or o[1] > f["fit_r"] or o[2] < f["fit_d"]))
            assert not dominated
    assert len({(f["fit_p"], f["fit_r"], f["fit_d"]) for f in front}) == len(front)
    crowd = pareto.crowding_distance(pareto.pareto_front(m)).collect()
    if len(crowd) > 2:
        assert sum(1 for c in crowd if c["crowding"] == float("inf")) >= 2
    best = pareto.beta_best(pareto.pareto_front(m)).collect()
    assert len(best) == 1 and 0.1 <= best[0]["beta"] <= 1.0


@pytest.fixture(scope="module")
def small(spark):
    """Two columns of three bins: every set of up to three rules can be listed."""
    rnd = random.Random(3)
    rows = [(float(rnd.randint(0, 2)), float(rnd.randint(0, 2))) for _ in range(160)]
    rows = [(a, b, 10 * a + 7 * (b == 1) + rnd.randint(0, 6)) for a, b in rows]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    th = {"a": [0.0, 1.0, 2.0, 3.0], "b": [0.0, 1.0, 2.0, 3.0]}
    space = Space(("a", "b"), th, "y", (11.0, 40.0))
    return rows, space, cube_ops.bucket_cube(df, space)


def _fitness(rows, rules):
    hits = [[all(lo <= r[c] < hi for c, lo, hi in rule) for r in rows] for rule in rules]
    pos = [11 < r[2] <= 40 for r in rows]
    if any(sum(h and p for h, p in zip(hit, pos)) <= 0.05 * sum(pos) for hit in hits):
        return None
    union = [any(x) for x in zip(*hits)]
    tp = sum(u and p for u, p in zip(union, pos))
    d = 0.0
    for hit in hits:
        y = [r[2] for r, h in zip(rows, hit) if h]
        d += sum((v - sum(y) / len(y)) ** 2 for v in y)
    return tp / sum(union), tp / sum(pos), d


def _better(a, b):
    return a[0] >= b[0] - 1e-12 and a[1] >= b[1] - 1e-12 and a[2] <= b[2] + 1e-6


def test_exact_front_of_all_sets_of_a_pool(spark, small):
    rows, space, cube = small
    pool = [[(0, 0, 1)], [(0, 1, 2)], [(0, 1, 3)], [(0, 2, 3)], [(1, 0, 2)], [(1, 1, 2)], [(0, 1, 2), (1, 1, 2)], [(0, 2, 3), (1, 0, 3)]]
    every = {}
    for n in range(1, len(pool) + 1):
        for w in itertools.combinations(pool, n):
            fit = _fitness(rows, w)
            if fit:
                every[tuple(map(tuple, w))] = fit
    front = [f for f in every.values() if not any(_better(g, f) and not _better(f, g) for g in every.values())]
    got = search.ruleset_front(cube, space, pool).collect()
    found = [(r["fit_p"], r["fit_r"], r["fit_d"]) for r in got]
    assert len({tuple(round(x, 5) for x in f) for f in front}) == len(found) >= 5
    for f in front:
        assert any(g == pytest.approx(f) for g in found)


def test_front_of_a_pool_without_feasible_rules(spark, small):
    _, space, cube = small
    (r,) = search.ruleset_front(cube, space, [[(0, 0, 1), (1, 0, 1)]]).collect()
    assert (r["fit_p"], r["fit_r"], r["feasible"]) == (0.0, 0.0, False)
    with pytest.raises(ValueError):
        search.ruleset_front(cube, space, [])


def test_archive_search_covers_what_enumeration_finds(spark, small):
    """Every set of up to two rules is within a box (a tenth, and a tenth of dissimilarity) of a set of the archive."""
    rows, space, cube = small
    width = 0.1
    got = [(r["fit_p"], r["fit_r"], r["fit_d"]) for r in search.beam_ruleset(cube, space, width).collect()]
    assert all(0 <= p <= 1 and 0 <= r <= 1 for p, r, _ in got)
    conds = [(c, lo, hi) for c in (0, 1) for lo in range(3) for hi in range(lo + 1, 4)]
    rules = [[x] for x in conds] + [[x, y] for x in conds for y in conds if x[0] < y[0]]
    missed = 0
    for n in (1, 2):
        for w in itertools.combinations(rules, n):
            fit = _fitness(rows, w)
            if fit and not any(p >= fit[0] - width and r >= fit[1] - width and d <= fit[2] * (1 + width) + 1 for p, r, d in got):
                missed += 1
    assert missed == 0


def test_best_first_at_twelve_columns(spark):
    rng = random.Random(12)
    rows = []
    for _ in range(400):
        x = [float(rng.randint(0, 3)) for _ in range(12)]
        hit = x[2] >= 1 and x[7] < 2 and x[11] >= 2
        rows.append((*x, (100.0 if hit else 0.0) + rng.randint(0, 9) + (100 if rng.random() < 0.03 else 0)))
    cols = [f"c{i:02d}" for i in range(12)]
    space = Space(tuple(cols), {c: [0.0, 1.0, 2.0, 4.0] for c in cols}, "y", (90.0, 300.0))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols) + ", y double")
    cube = cube_ops.bucket_cube(df, space)
    (r,) = search.best_rule(cube, space).collect()
    assert {(x["c"], x["lo"], x["hi"]) for x in r["rule"]} >= {(2, 1, 3), (7, 0, 2), (11, 2, 3)}
    (few,) = search.best_rule(cube, space, depth=2).collect()
    want = _best_by_enumeration(spark, cube, search.usable_conditions(space), 2)[(0, 1)]
    assert (-few["fmeasure"], len(few["rule"]), few["rule_id"]) == want and r["fmeasure"] > few["fmeasure"]


@pytest.mark.parametrize("portion", [40])
def test_best_first_on_four_columns_is_exhaustive(spark, portion):
    rng = random.Random(portion)
    rows = [(*[float(rng.randint(0, 3)) for _ in range(4)], float(rng.randint(0, 40))) for _ in range(200)]
    rows = [(*r[:4], r[4] + 15 * (r[0] > 1) + 9 * (r[3] == 2)) for r in rows]
    cols = list("abcd")
    space = Space(tuple(cols), {c: [0.0, 1.0, 3.0, 4.0] for c in cols}, "y", (10.0, 30.0, 60.0))
    cube = cube_ops.bucket_cube(spark.createDataFrame(rows, "a double, b double, c double, d double, y double"), space)
    ivs = [(0, 1), (1, 2), (0, 2)]
    got = {(r["j"], r["i"]): (-r["fmeasure"], len(r["rule"]), r["rule_id"]) for r in search.best_rule(cube, space, intervals=ivs, portion=portion).collect()}
    assert got == _best_by_enumeration(spark, cube, search.usable_conditions(space), 4, ivs)


def test_segmentation_matches_enumeration(spark, data):
    df, space, _ = data
    splits = segment.split_points(df, "y", [0.0, 0.3, 0.6, 1.0])
    scores = segment.segment_scores(df, space, splits).cache()
    f = {(r["j"], r["i"]): r["fmeasure"] for r in scores.collect()}
    got = segment.best_segmentation(scores, len(splits)).orderBy("seg").collect()
    n = len(splits) - 1
    best = None
    for k in range(n):
        for cuts in itertools.combinations(range(1, n), k):
            starts = [0, *cuts]
            ends = [*cuts, n]
            total = 0.0
            for j, i in zip(starts, ends):
                total += f[(j, i)]
            cand = (-total, list(reversed(starts)))
            if best is None or cand < best:
                best = cand
    assert [r["j"] for r in got] == list(reversed(best[1]))
    assert got[0]["total"] == pytest.approx(-best[0])
    assert len(got) < len(splits)


def test_segmentation_of_many_points(spark):
    n = 41
    rnd = random.Random(5)
    f = {(j, i): rnd.random() / (1 + abs(i - j - 3)) for i in range(1, n) for j in range(i)}
    scores = spark.createDataFrame([(j, i, v) for (j, i), v in f.items()], "j int, i int, fmeasure double")
    best = [(0.0, [])]
    for i in range(1, n):
        best.append(max(((best[j][0] + f[j, i], [*best[j][1], j]) for j in range(i)), key=lambda b: (b[0], -b[1][-1])))
    seg = segment.best_segmentation(scores, n)
    got = seg.orderBy("seg").collect()
    assert [r["j"] for r in got] == best[-1][1]
    assert [r["i"] for r in got] == [*best[-1][1][1:], n - 1]
    assert got[0]["total"] == pytest.approx(best[-1][0])
    size = [len(segment.best_segmentation(scores, m)._jdf.queryExecution().analyzed().toString().splitlines())
            for m in (4, 40)]
    assert size[0] == size[1]


def test_front_and_crowding_of_many_points(spark):
    rnd = random.Random(11)
    pairs = [(k / 300, (k * 7 % 300) / 300) for k in range(300)]
    pts = [(f"s{k:03d}", p, r, 10 * (p + r) + rnd.random()) for k, (p, r) in enumerate(pairs)]  # better costs more
    pts += [("zz", *pts[0][1:])]
    df = spark.createDataFrame(pts, "set_id string, fit_p double, fit_r double, fit_d double").repartition(5)

    def beats(b, a):
        return b[1] >= a[1] and b[2] >= a[2] and b[3] <= a[3] and b[1:] != a[1:]

    want = sorted(a for a in pts if a[0] != "zz" and not any(beats(b, a) for b in pts))
    front = pareto.pareto_front(df)
    assert sorted(map(tuple, front.collect())) == want and len(want) > 20
    plan = front._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    crowd = {r["set_id"]: r["crowding"] for r in pareto.crowding_distance(front).collect()}
    total = dict.fromkeys(crowd, 0.0)
    for col, sign in ((1, 1), (2, 1), (3, -1)):
        order = sorted(want, key=lambda p: (sign * p[col], p[0]))
        span = 3 * (order[-1][col] - order[0][col]) * sign
        for before, p, after in zip([None, *order], order, [*order[1:], None]):
            total[p[0]] += float("inf") if before is None or after is None else sign * (after[col] - before[col]) / span
    assert crowd == pytest.approx(total)


def test_segmentation_single_point(spark):
    scores = spark.createDataFrame([], "j int, i int, fmeasure double")
    assert segment.best_segmentation(scores, 1).count() == 0


def test_branch_and_bound_support_bound_option(spark, data):
    _, space, cube = data
    exact = search.branch_and_bound(cube, space).collect()[0]
    pruned = search.branch_and_bound(cube, space, support_bound=True).collect()[0]
    assert pruned["fmeasure"] <= exact["fmeasure"] + 1e-12
    assert 0 <= pruned["fmeasure"] <= 1


def test_beam_searches_do_not_depend_on_partitioning(spark, data, small):
    _, space, cube = data
    old = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    try:
        for parts in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            front = search.beam_ruleset(small[2], small[1], width=0.6)
            rule = search.beam_rule(cube, space, width=4)
            got.append((sorted(tuple(r) for r in front.select("set_id", "fit_p", "fit_r", "fit_d").collect()),
                        rule.select("rule_id").collect()[0][0]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got[0] == got[1]
