"""Rule and rule-set metrics: exact unit vectors and cube-vs-direct differential checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanrules.operators import cube as cube_ops
from spanrules.operators import scoring
from spanrules.operators.cube import Space
from spanrules.operators.space import rules_up_to, condition_list, with_rule_id
from spanrules.operators.thresholds import quantile_thresholds


def make_space(spark, rows, cols, thresholds, target, lo, hi):
    df = spark.createDataFrame(rows, ", ".join([f"{c} double" for c in cols] + [f"{target} double"]))
    space = Space(tuple(cols), thresholds, target, (float(lo), float(hi)))
    return df, space, cube_ops.bucket_cube(df, space).cache()


def sets_frame(spark, sets):
    """``sets``: list of lists of rules, a rule = list of (c, lo, hi) index triples."""
    from spanrules.operators.search import canonical_sets
    rows = [([[{"c": c, "lo": lo, "hi": hi} for c, lo, hi in r] for r in s],) for s in sets]
    df = spark.createDataFrame(rows, f"rules {scoring.RULE_TYPE.join(['array<', '>'])}")
    return df.withColumn("set_id", scoring.set_key(F.col("rules")))


def rules_frame(spark, rules):
    rows = [([{"c": c, "lo": lo, "hi": hi} for c, lo, hi in r],) for r in rules]
    return with_rule_id(spark.createDataFrame(rows, f"rule {scoring.RULE_TYPE}"))


def test_threshold_counts_match_numpy(spark):
    rng = np.random.default_rng(31)
    x, y = rng.integers(0, 12, 90).astype(float), rng.normal(70.0, 15.0, 90)
    cuts = [0.0, 3.0, 5.0, 11.0, 13.0]
    _, space, cube = make_space(spark, list(zip(x.tolist(), y.tolist())), ["x"], {"x": cuts}, "y", 62.5, 81.0)
    inside = (y > 62.5) & (y <= 81.0)
    got = {r["threshold"]: (r["positives"], r["negatives"])
           for r in cube_ops.threshold_counts(cube, space).collect()}
    assert got == {t: (int((inside & (x >= t)).sum()), int((~inside & (x >= t)).sum())) for t in cuts}


def _unit_space(spark, pos_x, neg_x, n_bins):
    """Traces with rule column ``x`` (bin index) and target 1 (positive) or 0 (negative)."""
    rows = [(float(x), 1.0) for x in pos_x] + [(float(x), 0.0) for x in neg_x]
    th = {"x": [float(i) for i in range(n_bins + 1)]}
    return make_space(spark, rows, ["x"], th, "y", 0.5, 1.0)


def _set_metrics(spark, cube, sets):
    m = scoring.ruleset_metrics(cube, sets_frame(spark, sets))
    return {r["set_id"]: r for r in m.collect()}


@pytest.mark.parametrize("pos_bins, expected", [
    ([], 0.0),            # no rule matches any positive
    ([0, 1], 0.5),        # two of four positives
    ([0, 1, 2, 3], 1.0),  # all positives
])
def test_recall(spark, pos_bins, expected):
    _, _, cube = _unit_space(spark, [0, 1, 2, 3], [], 5)
    rules = [[(0, b, b + 1)] for b in pos_bins] or [[(0, 4, 5)]]
    got = _set_metrics(spark, cube, [rules])
    assert list(got.values())[0]["recall"] == expected


@pytest.mark.parametrize("neg, expected", [([0, 1], 0.5), ([], 1.0)])
def test_precision(spark, neg, expected):
    _, _, cube = _unit_space(spark, [0, 1], neg, 2)
    got = _set_metrics(spark, cube, [[[(0, 0, 1)], [(0, 1, 2)]]])
    assert list(got.values())[0]["precision"] == expected


def test_precision_zero(spark):
    _, _, cube = _unit_space(spark, [2], [0, 1], 3)
    got = _set_metrics(spark, cube, [[[(0, 0, 1)], [(0, 1, 2)]]])
    assert list(got.values())[0]["precision"] == 0.0


@pytest.mark.parametrize("rules, expected", [
    ([[(0, 0, 1)], [(0, 0, 1)], [(0, 0, 1)]], 0.0),   # every match is shared
    ([[(0, 0, 2)], [(0, 0, 1)]], 1 / 3),              # 1 unique of 3 matches
    ([[(0, 0, 1)], [(0, 1, 2)]], 1.0),                 # disjoint
])
def test_disjointness(spark, rules, expected):
    _, _, cube = _unit_space(spark, [0], [1], 2)
    got = _set_metrics(spark, cube, [rules])
    assert list(got.values())[0]["disjointness"] == pytest.approx(expected)


def test_dissimilarity_and_sizes(spark):
    rows = [(0.0, 10.0), (0.0, 20.0), (1.0, 30.0), (1.0, 50.0)]
    th = {"x": [0.0, 1.0, 2.0]}
    _, _, cube = make_space(spark, rows, ["x"], th, "y", 15.0, 60.0)
    got = _set_metrics(spark, cube, [[[(0, 0, 1)], [(0, 0, 2)]]])
    r = list(got.values())[0]
    # rule 1: {10, 20} -> 25 + 25; rule 2: {10, 20, 30, 50}, mean 27.5 -> 306.25 + 56.25 + 6.25 + 506.25
    assert r["dissimilarity"] == pytest.approx(50.0 + 875.0)
    assert r["sizes"] == [2, 4]
    assert r["feasible"]  # each rule alone recalls > 5 % of the 3 positives


def test_empty_rule_and_no_match(spark):
    _, _, cube = _unit_space(spark, [0, 1], [1], 3)
    got = {r["rule_id"]: r for r in scoring.score_rules(cube, rules_frame(spark, [[], [(0, 2, 3)]])).collect()}
    assert (got[""]["tp"], got[""]["fp"]) == (2, 1)
    assert (got["0:2:3"]["tp"], got["0:2:3"]["support"], got["0:2:3"]["fmeasure"]) == (0, 0, 0.0)


def test_no_positives_raises(spark):
    _, _, cube = _unit_space(spark, [], [0, 1], 2)
    with pytest.raises(ValueError):
        scoring.score_rules(cube, rules_frame(spark, [[]])).collect()


def test_nan_and_null_match_nothing(spark):
    rows = [(float("nan"), 1.0), (None, 1.0), (0.5, 1.0), (0.5, 0.0)]
    _, _, cube = make_space(spark, rows, ["x"], {"x": [0.0, 1.0]}, "y", 0.5, 1.0)
    got = scoring.score_rules(cube, rules_frame(spark, [[(0, 0, 1)]])).collect()[0]
    assert (got["tp"], got["fp"], got["P"]) == (1, 1, 3)


def test_every_pair_rule_matches_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 9, (150, 3)).astype(float)
    y = 10 * x[:, 0] - 4 * x[:, 2] + rng.normal(0, 6, 150)
    cols = ["u", "v", "w"]
    cuts = {"u": [0.0, 2.0, 7.0], "v": [1.0, 4.0, 8.0, 9.0], "w": [0.0, 5.0, 9.0]}
    space = Space(tuple(cols), cuts, "y", (5.0, 55.0))
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y)]
    df = spark.createDataFrame(rows, "u double, v double, w double, y double")
    rules = rules_up_to(spark, condition_list(space), 2)
    scored = scoring.score_rules(cube_ops.bucket_cube(df, space), rules).collect()
    assert len(scored) == rules.count()
    positive = (y > 5.0) & (y <= 55.0)
    for r in scored:
        hit = np.ones(len(y), bool)
        for c in r["rule"]:
            v = x[:, c["c"]]
            hit &= (v >= cuts[cols[c["c"]]][c["lo"]]) & (v < cuts[cols[c["c"]]][c["hi"]])
        tp, support = int((hit & positive).sum()), int(hit.sum())
        assert (r["tp"], r["fp"]) == (tp, support - tp)
        f = 2 * tp / (support + positive.sum()) if support else 0.0
        assert r["fmeasure"] == pytest.approx(f, abs=1e-12)


def test_repeated_candidates_count_once(spark):
    _, _, cube = _unit_space(spark, [0, 1], [0], 2)
    rows = scoring.score_rules(cube, rules_frame(spark, [[(0, 0, 1)], [(0, 0, 1)]])).collect()
    assert len(rows) == 2
    assert {(r["tp"], r["fp"], r["recall"]) for r in rows} == {(1, 1, 0.5)}
    sets = scoring.ruleset_metrics(cube, sets_frame(spark, [[[(0, 0, 1)]], [[(0, 0, 1)]]])).collect()
    assert {(r["tp"], r["fp"], r["recall"]) for r in sets} == {(1, 1, 0.5)}


def test_dissimilarity_far_from_zero(spark):
    rows = [(0.0, 1e8 + 0.1), (0.0, 1e8 + 0.2), (0.0, 1e8 + 0.3), (1.0, 1e8 + 5.0)]
    _, _, cube = make_space(spark, rows, ["x"], {"x": [0.0, 1.0, 2.0]}, "y", 1e8 + 0.15, 1e8 + 9.0)
    (r,) = _set_metrics(spark, cube, [[[(0, 0, 1)]]]).values()
    assert r["dissimilarity"] == pytest.approx(0.02, abs=1e-6) and r["dissimilarity"] >= 0


def test_rule_growth_counts(spark):
    space = Space(("a", "b"), {"a": [0.0, 1.0, 2.0], "b": [0.0, 1.0, 2.0]}, "y", (0.0, 1.0))
    conds = condition_list(space)
    assert len(conds) == 6
    rules = rules_up_to(spark, conds, 2)
    assert rules.count() == 1 + 6 + 9
    assert rules.select("rule_id").distinct().count() == 16


def test_no_negatives_allowed(spark):
    _, _, cube = _unit_space(spark, [0, 1], [], 2)
    got = scoring.score_rules(cube, rules_frame(spark, [[(0, 0, 1)], []])).collect()
    by = {r["rule_id"]: r for r in got}
    assert (by["0:0:1"]["fp"], by["0:0:1"]["precision"], by["0:0:1"]["recall"]) == (0, 1.0, 0.5)
    assert by[""]["fmeasure"] == 1.0


def test_constant_column_thresholds(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0)], "x double, y double")
    assert quantile_thresholds(df, ["x"], [0.0, 0.5])["x"] == [5.0, 6.0]


def _wide(spark, n=300, k=12, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 5, (n, k)).astype(float)
    x[rng.random((n, k)) < 0.05] = np.nan
    y = np.nansum(x[:, :3], 1) * 10 + rng.integers(0, 9, n)
    cols = [f"c{i}" for i in range(k)]
    cuts = {c: [0.0, 1.0, 3.0, 5.0] if i % 2 else [0.0, 2.0, 4.0] for i, c in enumerate(cols)}
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], ", ".join(f"{c} double" for c in cols) + ", y double")
    return x, y, df, Space(tuple(cols), cuts, "y", (30.0, 70.0))


def _expected(x, y, space, rule):
    hit = np.ones(len(y), bool)
    for c, lo, hi in rule:
        v, t = x[:, c], space.thresholds[space.cols[c]]
        hit &= (v >= t[lo]) & (v < t[hi])
    pos = (y > space.splits[0]) & (y <= space.splits[1])
    return int((hit & pos).sum()), int((hit & ~pos).sum())


def _some_rules(space, n, seed=9):
    rng = np.random.default_rng(seed)
    out = {()}
    while len(out) < n:
        k = int(rng.choice([1, 2, 2, 3, 5, 12]))
        rule = []
        for c in sorted(rng.choice(len(space.cols), k, replace=False)):
            m = len(space.thresholds[space.cols[c]])
            lo = int(rng.integers(0, m - 1))
            rule.append((int(c), lo, int(rng.integers(lo + 1, m)) if k < 5 else m - 1))
        out.add(tuple(rule))
    return [list(r) for r in sorted(out)]


@pytest.mark.parametrize("grid", [1 << 16, 60, 1])
def test_twelve_columns_by_corners_and_bitmaps(spark, grid):
    x, y, df, space = _wide(spark)
    rules = _some_rules(space, 60)
    sc = scoring.Scorer.for_space(cube_ops.bucket_cube(df, space), space, grid=grid)
    got = sc.score(rules_frame(spark, rules)).collect()
    assert len(got) == len(rules)
    for r in got:
        assert (r["tp"], r["fp"]) == _expected(x, y, space, [(c["c"], c["lo"], c["hi"]) for c in r["rule"]])


def test_bitmaps_over_cells_that_stand_for_many_traces(spark):
    x, y, df, space = _wide(spark, n=900, k=2)
    rules = [[], [(0, 0, 1), (1, 1, 3)], [(1, 0, 2)], [(0, 1, 2)]]
    sc = scoring.Scorer.for_space(cube_ops.bucket_cube(df, space), space, grid=0)
    assert sc.index().targets.agg(F.max("digit")).first()[0] > 3
    for r in sc.score(rules_frame(spark, rules)).collect():
        assert (r["tp"], r["fp"]) == _expected(x, y, space, [(c["c"], c["lo"], c["hi"]) for c in r["rule"]])


def test_bitmap_portions(spark, monkeypatch):
    from spanrules.operators import bitmaps
    monkeypatch.setattr(bitmaps, "PORTION_KEYS", 40)
    x, y, df, space = _wide(spark, n=120, k=6)
    rules = [[(0, 0, 1), (1, 0, 2)], [(2, 0, 2), (3, 1, 3), (5, 0, 1)], [(4, 0, 1), (5, 1, 2)]]
    got = scoring.Scorer.for_space(cube_ops.bucket_rows(df, space), space, grid=1).score(rules_frame(spark, rules)).collect()
    assert len(got) == 3
    for r in got:
        assert (r["tp"], r["fp"]) == _expected(x, y, space, [(c["c"], c["lo"], c["hi"]) for c in r["rule"]])


def test_bitmaps_of_blocks_are_not_sorted_rule_by_rule(spark, monkeypatch):
    from spanrules.operators import bitmaps
    monkeypatch.setattr(bitmaps, "RULES_AT_ONCE", 2)
    x, y, df, space = _wide(spark, n=40000, k=3)
    rules = [[], [(0, 0, 1), (1, 0, 2)], [(2, 0, 2)], [(0, 0, 2), (1, 1, 3), (2, 0, 1)], [(1, 1, 2)]]
    sc = scoring.Scorer.for_space(cube_ops.bucket_rows(df.coalesce(1), space), space, grid=0)
    assert sc.index().table.select("block").distinct().count() == 2
    frame = rules_frame(spark, rules)
    plan = sc.index().counts(frame)._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_and_agg" not in plan and "SortAggregate" not in plan  # a bitmap for each block and rule
    for r in sc.score(frame).collect():
        assert (r["tp"], r["fp"]) == _expected(x, y, space, [(c["c"], c["lo"], c["hi"]) for c in r["rule"]])


def test_rule_sets_by_inclusion_and_exclusion(spark):
    x, y, df, space = _wide(spark, n=250, k=5)
    sets = [[[(0, 0, 1)], [(0, 1, 2), (1, 0, 2)], [(1, 0, 3)], [(2, 0, 2), (3, 1, 3)]],
            [[(0, 0, 2)], [(0, 0, 2)], [(0, 0, 1), (4, 0, 1)]], [[(3, 0, 1)], [(3, 1, 2)], [(3, 2, 3)]], [[]]]
    cube = cube_ops.bucket_cube(df, space)
    for sc in (scoring.Scorer.for_space(cube, space), scoring.Scorer.for_space(cube, space, grid=3)):
        got = {r["set_id"]: r for r in sc.ruleset_metrics(sets_frame(spark, sets)).collect()}
        pos = (y > 30) & (y <= 70)
        for rules in sets:
            hits = []
            for rule in rules:
                hit = np.ones(len(y), bool)
                for c, lo, hi in rule:
                    t = space.thresholds[space.cols[c]]
                    hit &= (x[:, c] >= t[lo]) & (x[:, c] < t[hi])
                hits.append(hit)
            m = np.sum(hits, 0)
            key = "|".join(";".join(f"{c}:{lo}:{hi}" for c, lo, hi in rule) for rule in rules)
            r = got[key]
            assert (r["tp"], r["fp"]) == (int(((m > 0) & pos).sum()), int(((m > 0) & ~pos).sum()))
            assert r["disjointness"] == pytest.approx((m == 1).sum() / m.sum())
            assert r["sizes"] == [int(h.sum()) for h in hits]
            assert r["dissimilarity"] == pytest.approx(sum(((y[h] - y[h].mean()) ** 2).sum() for h in hits if h.any()))


def test_scorer_measures_whether_the_cube_saves_anything(spark):
    x, y, df, space = _wide(spark, n=200, k=12)
    wide = scoring.scorer_for(df, space)
    assert wide.wide((0, 1)) and not wide.wide((3,))
    narrow = Space(space.cols[:1], {space.cols[0]: space.thresholds[space.cols[0]]}, "y", space.splits)
    assert not scoring.scorer_for(df, narrow).wide((0,))
    rules = [[(0, 0, 1)], [(0, 0, 2), (5, 0, 2)], []]
    for r in wide.score(rules_frame(spark, rules)).collect():
        assert (r["tp"], r["fp"]) == _expected(x, y, space, [(c["c"], c["lo"], c["hi"]) for c in r["rule"]])


def test_no_rule_meets_the_cells_of_its_column_set(spark):
    _, _, df, space = _wide(spark, n=50, k=3)
    sc = scoring.Scorer.for_space(cube_ops.bucket_cube(df, space), space)
    plan = sc.rule_counts(rules_frame(spark, [[(0, 0, 1), (1, 0, 2)], [(2, 0, 1)]]))._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert joins and all("at#" in x and "cs#" in x for x in joins)
