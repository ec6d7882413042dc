"""Rule search on the bucket cube.

* :func:`branch_and_bound` - exact best conjunction of adjacent-bin features (one per column),
  level by level; the frontier is a DataFrame, pruned by the recall bound.
* :func:`best_rule` - exact best rule of feasible conditions, of any number or at most ``depth``, best first.
* :func:`rule_neighbours` / :func:`beam_rule` - complete neighbourhoods (add, remove, modify a
  condition; recombine two rules) scored in one job per round, best ``width`` kept.
* :func:`ruleset_neighbours` / :func:`beam_ruleset` - the same for rule sets under the three
  objectives (precision, recall, dissimilarity), keeping an archive of boxes.
* :func:`ruleset_front` - the exact Pareto front of all sets of a pool of rules, by branch and bound.

The searches end at a fixed point: when every rule of the beam, or every set of the archive, has been
expanded and nothing better came of it. Every round is one scoring job over all candidates; the
driver only learns whether any are left. What a round adds is written to the shared checkpoint
folder as a table of its own, so a round writes what is new and no more.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanrules.operators import pareto, scoring
from spanrules.operators.cube import Space
from spanrules.operators.scoring import RULE_TYPE, rule_key, set_key
from spanrules.operators.space import (bin_feature_list, condition_list, cond_array, extend_rules,
                                       rules_up_to, seed_rules, with_rule_id)
from spanrules.session import cut_lineage

SET_TYPE = f"array<{RULE_TYPE}>"


def _best_order() -> Column:
    return F.struct((-F.col("fmeasure")).alias("f"), F.size("rule").alias("s"),
                    F.col("rule_id").alias("k"))


# ------------------------------------------------------------------ branch and bound

def branch_and_bound(cube: DataFrame, space: Space,
                     intervals: Sequence[tuple[int, int]] = ((0, 1),),
                     features: Sequence[tuple[int, int, int]] | None = None,
                     support_bound: bool = False) -> DataFrame:
    """Exact best rule over adjacent-bin features, one per column, for every interval.

    Better = higher F, then fewer conditions, then smaller rule key. A node whose recall is below
    ``F*/(2 - F*)`` is not expanded: its descendants have no more recall and
    ``F <= 2r/(1 + r)``. Children only take columns after the node's last column, so every
    subset is visited once. Output per interval ``(j, i)``: the best scored rule.

    ``support_bound=True`` adds the support-decrease test of the source model: a child is kept
    only if ``S_parent - S >= (S_parent - mu) / remaining``, ``mu = min over the path of
    P / precision``, ``remaining`` = features left to the parent. It is not proven safe (it may
    drop the optimum), hence off by default.
    """
    spark = cube.sparkSession
    feats = list(features if features is not None else bin_feature_list(space))
    farr = cond_array(feats)
    scorer = scoring.Scorer.for_space(cube, space, intervals)
    level = scorer.score(with_rule_id(seed_rules(spark)))
    best = cut_lineage(scoring.best_per_interval(level))

    def remaining(rule: Column) -> Column:
        last = F.coalesce(F.array_max(F.transform(rule, lambda x: x["c"])), F.lit(-1))
        return F.size(F.filter(farr, lambda x: x["c"] > last))

    def node_mu(prev: Column) -> Column:
        own = F.when(F.col("precision") > 0, F.col("P") / F.col("precision")).otherwise(F.lit(float("inf")))
        return F.least(prev, own)

    frontier = level.select("rule", "rule_id", "j", "i", "recall", "support",
                            node_mu(F.lit(float("inf"))).alias("mu"),
                            remaining(F.col("rule")).alias("rem"))
    for _ in range(len(space.cols)):
        parents = frontier.select("rule", "j", "i", F.col("support").alias("p_support"),
                                  F.col("mu").alias("p_mu"), F.col("rem").alias("p_rem"))
        kids = cut_lineage(with_rule_id(extend_rules(parents, feats)))
        scored = scorer.score(kids.select("rule", "rule_id").distinct())
        scored = scored.join(kids.select("rule_id", "j", "i", "p_support", "p_mu", "p_rem").distinct(),
                             ["rule_id", "j", "i"])
        if support_bound:
            drop = F.col("p_support") - F.col("support")
            scored = scored.filter(drop >= (F.col("p_support") - F.col("p_mu")) / F.col("p_rem"))
        scored = cut_lineage(scored)
        best = cut_lineage(scoring.best_per_interval(
            best.unionByName(scored.select(best.columns))))
        bound = best.select("j", "i", (F.col("fmeasure") / (F.lit(2.0) - F.col("fmeasure"))).alias("rb"))
        frontier = cut_lineage(scored.join(F.broadcast(bound), ["j", "i"])
                          .filter(F.col("recall") >= F.col("rb"))
                          .select("rule", "rule_id", "j", "i", "recall", "support",
                                  node_mu(F.col("p_mu")).alias("mu"), remaining(F.col("rule")).alias("rem")))
        if frontier.isEmpty():
            break
    return best


# ------------------------------------------------------------------ best rule

def usable_conditions(space: Space) -> list[tuple[int, int, int]]:
    """Feasible conditions on columns with more than two thresholds."""
    return condition_list(space, feasible_only=True, min_thresholds=3)


PORTION = 4096  # nodes opened in a round


def best_rule(cube: DataFrame, space: Space, depth: int | None = None,
              intervals: Sequence[tuple[int, int]] = ((0, 1),), portion: int = PORTION) -> DataFrame:
    """Best rule of feasible conditions per interval, exact: best-first branch and bound.

    A node is a rule and an interval; its children add a condition on a column after its last one, so each
    rule comes up once. Conditions only take matches away, so a rule below a node has at most the node's true
    positives and at best no false ones: ``F <= 2 r / (1 + r)``. In each round the ``portion`` nodes of the highest bound
    are opened and their children scored in one job; nodes whose bound is below the best F found so far
    are dropped (not those that reach it: a rule of equal F may have fewer conditions or a smaller key). The
    search ends when no node is left, whatever the number of columns. ``depth`` may bound the number
    of conditions.
    """
    spark = cube.sparkSession
    conds = usable_conditions(space)
    scorer = scoring.Scorer.for_space(cube, space, intervals)
    last = max((c for c, _, _ in conds), default=-1)
    depth = len(space.cols) if depth is None else depth
    start = cut_lineage(scorer.score(with_rule_id(seed_rules(spark))))
    best = cut_lineage(scoring.best_per_interval(start))

    def nodes(scored: DataFrame) -> DataFrame:
        top = F.coalesce(F.array_max(F.transform("rule", lambda x: x["c"])), F.lit(-1))
        return (scored.where((top < last) & (F.size("rule") < depth))
                .select("rule", "rule_id", "j", "i", F.try_divide(2 * F.col("recall"), 1 + F.col("recall")).alias("bound")))

    def promising(open_: DataFrame) -> DataFrame:
        reach = best.select(F.col("j").alias("b_j"), F.col("i").alias("b_i"), F.col("fmeasure").alias("goal"))
        return open_.join(F.broadcast(reach), (F.col("j") == F.col("b_j")) & (F.col("i") == F.col("b_i"))
                          & (F.col("bound") >= F.col("goal"))).select(*open_.columns)  # a row for each interval

    open_ = cut_lineage(promising(nodes(start)))
    while not open_.isEmpty():
        taken = cut_lineage(open_.orderBy(F.desc("bound"), "rule_id", "j", "i").limit(portion))
        kids = cut_lineage(with_rule_id(extend_rules(taken.select("rule", "j", "i"), conds)))
        scored = scorer.score(kids.select("rule", "rule_id").distinct())
        scored = cut_lineage(scored.join(kids.select("rule_id", "j", "i"), ["rule_id", "j", "i"]))
        best = cut_lineage(scoring.best_per_interval(best.unionByName(scored.select(best.columns))))
        rest = open_.join(taken.select("rule_id", "j", "i"), ["rule_id", "j", "i"], "left_anti").select(*open_.columns)
        open_ = cut_lineage(promising(rest.unionByName(nodes(scored))))
    return best


# ------------------------------------------------------------------ rule neighbourhoods

def _nth_array(space: Space) -> Column:
    return F.array(*[F.lit(len(space.thresholds[c])) for c in space.cols])


def rule_neighbours(rules: DataFrame, space: Space,
                    conds: Sequence[tuple[int, int, int]] | None = None) -> DataFrame:
    """All rules one move away from each input rule: ``(parent_id, move, rule, rule_id)``.

    Moves: ``add`` a condition on an unused column; ``remove`` one condition; ``modify`` one end
    of one condition to any other threshold index (ends re-sorted, empty intervals skipped).
    The parents themselves are removed (``left_anti`` on their keys).
    """
    conds = list(conds if conds is not None else usable_conditions(space))
    base = rules.select(F.col("rule_id").alias("parent_id"), "rule")
    used = F.transform("rule", lambda x: x["c"])
    add = (base.select("parent_id", "rule", F.explode(F.filter(
                cond_array(conds), lambda x: ~F.array_contains(used, x["c"]))).alias("x"))
               .select("parent_id", F.lit("add").alias("move"),
                       F.array_sort(F.array_append("rule", F.col("x"))).alias("rule")))
    pos = base.select("parent_id", "rule", F.posexplode("rule").alias("k", "x"))
    remove = pos.select("parent_id", F.lit("remove").alias("move"),
                        F.filter("rule", lambda _, i: i != F.col("k")).alias("rule"))
    nth = _nth_array(space)
    mod = (pos.select("parent_id", "rule", "k", "x",
                      F.explode(F.sequence(F.lit(0), nth[F.col("x.c")] - 1)).alias("v"))
              .select("parent_id", "rule", "k", "x", "v",
                      F.explode(F.array(F.array(F.col("v"), F.col("x.hi")),
                                        F.array(F.col("x.lo"), F.col("v")))).alias("ends")))
    mod = (mod.filter(F.col("ends")[0] != F.col("ends")[1])
              .select("parent_id", "rule", "k", "x",
                      F.least(F.col("ends")[0], F.col("ends")[1]).alias("lo"),
                      F.greatest(F.col("ends")[0], F.col("ends")[1]).alias("hi"))
              .filter((F.col("lo") != F.col("x.lo")) | (F.col("hi") != F.col("x.hi")))
              .select("parent_id", F.lit("modify").alias("move"),
                      F.array_sort(F.transform("rule", lambda y, i: F.when(
                          i == F.col("k"), F.struct(y["c"].alias("c"), F.col("lo").alias("lo"),
                                                    F.col("hi").alias("hi"))).otherwise(y))).alias("rule")))
    out = (add.unionByName(remove).unionByName(mod)
              .withColumn("rule", F.col("rule").cast(RULE_TYPE))
              .withColumn("rule_id", rule_key(F.col("rule"))))
    out = out.join(rules.select(F.col("rule_id")), "rule_id", "left_anti")
    return out.dropDuplicates(["parent_id", "move", "rule_id"])


def recombine_rules(beam: DataFrame) -> DataFrame:
    """Children of every ordered pair of beam rules: ``a`` plus ``b``'s conditions on the
    columns ``a`` does not use. The beam (bounded by its width) is gathered into one row, sorted
    by key so the result does not depend on partition order, and exploded twice (no join)."""
    packed = beam.agg(F.array_sort(F.collect_list(F.struct("rule_id", "rule"))).alias("bs"))
    pairs = (packed.select(F.posexplode("bs").alias("ia", "a"), "bs")
                   .select("ia", "a", F.posexplode("bs").alias("ib", "b"))
                   .filter(F.col("ia") != F.col("ib")))
    used = F.transform("a.rule", lambda x: x["c"])
    child = F.array_sort(F.concat(F.col("a.rule"),
                                  F.filter("b.rule", lambda x: ~F.array_contains(used, x["c"]))))
    return (pairs.select(F.col("a.rule_id").alias("parent_id"), F.lit("recombine").alias("move"),
                         child.cast(RULE_TYPE).alias("rule"))
                 .withColumn("rule_id", rule_key(F.col("rule"))))


def _feasible_rule(space: Space) -> Column:
    """No condition spans its column's whole range (a rule with one gets fitness 0)."""
    nth = _nth_array(space)
    return F.forall("rule", lambda x: ~((x["lo"] == 0) & (x["hi"] == nth[x["c"]] - 1)))


def _all_of(tables: Sequence[DataFrame], *cols: str) -> DataFrame:
    out = tables[0].select(*cols) if cols else tables[0]
    for t in tables[1:]:
        out = out.unionByName(t.select(*cols) if cols else t)
    return out


def beam_rule(cube: DataFrame, space: Space, width: int = 10, lo_y: int = 0, hi_y: int = 1) -> DataFrame:
    """Best single rule by beam search over complete neighbourhoods.

    Start: the empty rule. Round: neighbours (add / remove / modify) of the beam's rules that have
    not been expanded yet, and recombinations of the beam, minus everything already scored, scored in
    one job; the beam is the best ``width`` rules seen (F desc, fewer conditions, key). Ends when every
    rule of the beam has been expanded. Returns the best rule (one row); it is the empty one if the
    space has no usable condition.
    """
    spark = cube.sparkSession
    scorer = scoring.Scorer.for_space(cube, space, [(lo_y, hi_y)])
    conds = usable_conditions(space)
    feasible = _feasible_rule(space)

    def scored(rules: DataFrame) -> DataFrame:
        return cut_lineage(scorer.score(rules.select("rule", "rule_id")).withColumn(
            "fit", F.when(feasible, F.col("fmeasure")).otherwise(F.lit(0.0))))

    def best_of(rows: DataFrame, n: int) -> DataFrame:
        return rows.orderBy(F.col("fit").desc(), F.size("rule"), "rule_id").limit(n)

    seen = [scored(with_rule_id(seed_rules(spark)))]
    expanded: list[DataFrame] = []
    beam = seen[0]
    while conds:
        fresh = beam if not expanded else beam.join(_all_of(expanded, "rule_id"), "rule_id", "left_anti")
        fresh = cut_lineage(fresh)
        if fresh.isEmpty():
            break
        expanded.append(fresh.select("rule_id"))
        cand = (rule_neighbours(fresh, space, conds).select("rule", "rule_id")
                .unionByName(recombine_rules(beam).select("rule", "rule_id"))
                .dropDuplicates(["rule_id"])
                .join(_all_of(seen, "rule_id"), "rule_id", "left_anti"))
        seen.append(scored(cut_lineage(cand)))
        beam = cut_lineage(best_of(beam.unionByName(seen[-1].select(beam.columns)), width))
    ranked = beam.where(feasible)
    return ranked.agg(F.min_by(F.struct(*beam.columns), _best_order()).alias("b")).select("b.*")


# ------------------------------------------------------------------ rule-set neighbourhoods

def canonical_sets(df: DataFrame) -> DataFrame:
    """Rules sorted inside, the set sorted, and ``set_id`` = its canonical text."""
    rules = F.array_sort(F.transform("rules", lambda r: F.array_sort(r))).cast(SET_TYPE)
    return df.withColumn("rules", rules).withColumn("set_id", set_key(F.col("rules")))


def _replace_at(k: Column, new: Column) -> Column:
    return F.transform("rules", lambda r, i: F.when(i == k, new).otherwise(r))


def _split_at(k: Column, a: Column, b: Column) -> Column:
    return F.flatten(F.transform("rules", lambda r, i: F.when(i == k, F.array(a, b))
                                 .otherwise(F.array(r))))


def ruleset_neighbours(sets: DataFrame, space: Space,
                       conds: Sequence[tuple[int, int, int]] | None = None) -> DataFrame:
    """All rule sets one move away: ``(parent_id, move, rules, set_id)``.

    Moves on the set: ``add_rule`` (a one-condition rule), ``remove_rule`` (sets of two or more),
    ``split`` a condition of width > 1 at each inner cut into two rules, ``complement`` a rule
    with ``[t_0, t_cut)`` and ``[t_cut, t_last)`` on a column it does not use (one shared cut).
    Moves on one rule: ``add_cond`` on an unused column, ``remove_cond`` (rules of two or more).
    Conditions come from the whole space: any column, any two thresholds.
    """
    conds = list(conds if conds is not None else condition_list(space))
    carr = cond_array(conds)
    nth = _nth_array(space)
    base = sets.select(F.col("set_id").alias("parent_id"), "rules")
    out = []
    out.append(base.select("parent_id", F.lit("add_rule").alias("move"),
                           F.explode(F.transform(carr, lambda x: F.concat(
                               F.col("rules"), F.array(F.array(x))))).alias("rules")))
    per_rule = base.select("parent_id", "rules", F.posexplode("rules").alias("k", "r"))
    out.append(per_rule.filter(F.size("rules") > 1).select(
        "parent_id", F.lit("remove_rule").alias("move"),
        F.filter("rules", lambda _, i: i != F.col("k")).alias("rules")))
    per_cond = per_rule.select("parent_id", "rules", "k", "r", F.posexplode("r").alias("q", "x"))
    inner = (per_cond.filter(F.col("x.hi") - F.col("x.lo") > 1)
                     .select("*", F.explode(F.sequence(F.col("x.lo") + 1, F.col("x.hi") - 1)).alias("cut")))

    def with_cond(r: Column, q: Column, lo: Column, hi: Column) -> Column:
        return F.transform(r, lambda y, i: F.when(i == q, F.struct(
            y["c"].alias("c"), lo.alias("lo"), hi.alias("hi"))).otherwise(y))

    out.append(inner.select("parent_id", F.lit("split").alias("move"), _split_at(
        F.col("k"), with_cond(F.col("r"), F.col("q"), F.col("x.lo"), F.col("cut")),
        with_cond(F.col("r"), F.col("q"), F.col("cut"), F.col("x.hi"))).alias("rules")))
    cols = F.array(*[F.lit(p) for p, c in enumerate(space.cols) if len(space.thresholds[c]) > 2]).cast("array<int>")
    used = F.transform("r", lambda x: x["c"])
    comp = (per_rule.select("*", F.explode(F.filter(cols, lambda c: ~F.array_contains(used, c))).alias("c"))
                    .select("*", F.explode(F.sequence(F.lit(1), nth[F.col("c")] - 2)).alias("cut")))

    def mk(c: Column, lo: Column, hi: Column) -> Column:
        return F.struct(c.alias("c"), lo.alias("lo"), hi.alias("hi"))

    out.append(comp.select("parent_id", F.lit("complement").alias("move"), _split_at(
        F.col("k"), F.array_append("r", mk(F.col("c"), F.lit(0), F.col("cut"))),
        F.array_append("r", mk(F.col("c"), F.col("cut"), nth[F.col("c")] - 1))).alias("rules")))
    addc = per_rule.select("parent_id", "rules", "k", "r", F.explode(F.filter(
        carr, lambda x: ~F.array_contains(used, x["c"]))).alias("x"))
    out.append(addc.select("parent_id", F.lit("add_cond").alias("move"),
                           _replace_at(F.col("k"), F.array_append("r", F.col("x"))).alias("rules")))
    out.append(per_cond.filter(F.size("r") > 1).select(
        "parent_id", F.lit("remove_cond").alias("move"),
        _replace_at(F.col("k"), F.filter("r", lambda _, i: i != F.col("q"))).alias("rules")))
    allm = out[0]
    for o in out[1:]:
        allm = allm.unionByName(o)
    allm = canonical_sets(allm)
    allm = allm.join(sets.select("set_id"), "set_id", "left_anti")
    return allm.dropDuplicates(["parent_id", "move", "set_id"])


def recombine_sets(beam: DataFrame) -> DataFrame:
    """Interleave two sets, either one first, and cut at every inner position (both halves kept)."""
    packed = beam.agg(F.array_sort(F.collect_list(F.struct("set_id", "rules"))).alias("bs"))
    pairs = (packed.select(F.posexplode("bs").alias("ia", "a"), "bs")
                   .select("ia", "a", F.posexplode("bs").alias("ib", "b"))
                   .filter(F.col("ia") != F.col("ib")))
    na, nb = F.size("a.rules"), F.size("b.rules")
    n = F.greatest(na, nb)
    mixed = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda t: F.array(
        F.get(F.col("a.rules"), t), F.get(F.col("b.rules"), t)))), lambda r: r.isNotNull())
    cut = (pairs.select(F.col("a.set_id").alias("parent_id"), mixed.alias("mixed"))
                .select("parent_id", "mixed", F.explode(F.sequence(F.lit(1), F.size("mixed") - 1)).alias("cut")))
    halves = cut.select("parent_id", F.explode(F.array(
        F.slice("mixed", F.lit(1), F.col("cut")),
        F.slice("mixed", F.col("cut") + 1, F.size("mixed") - F.col("cut")))).alias("rules"))
    return canonical_sets(halves.select("parent_id", F.lit("recombine").alias("move"), "rules"))


def single_condition_sets(spark: SparkSession, conds: Sequence[tuple[int, int, int]]) -> DataFrame:
    """The starting population: one rule of one condition per set."""
    base = spark.range(1).select(F.explode(cond_array(conds)).alias("x"))
    return canonical_sets(base.select(F.array(F.array("x")).alias("rules")))


# ------------------------------------------------------------------ exact front of rule sets

def ruleset_front(cube: DataFrame, space: Space, pool: Sequence[Sequence[tuple[int, int, int]]] | None = None,
                  lo_y: int = 0, hi_y: int = 1, min_rule_recall: float = 0.05) -> DataFrame:
    """The Pareto front (precision max, recall max, dissimilarity min) of all sets of rules of ``pool`` (by
    default the adjacent-bin conditions, one rule each), of any size: branch and bound by size.

    Only rules that are feasible alone take part. A set grows by rules after its last one, so each set
    comes up once. What a set can still become is bounded by

    * recall: its true positives and those of the union of the rules left, ``T``, at most;
    * precision: ``T / (T + FP)``, as false positives only grow;
    * dissimilarity: its own and the least that one rule left adds.

    A set whose bound some set of the front dominates is not grown further. The search ends when none is left
    to grow; the answer is that of full enumeration.
    """
    scorer = scoring.Scorer.for_space(cube, space, [(lo_y, hi_y)])
    spark = cube.sparkSession
    if pool is None:
        pool = [[x] for x in bin_feature_list(space)]
    rules = sorted({tuple(sorted((int(c), int(lo), int(hi)) for c, lo, hi in r)) for r in pool})

    def sets_of(which: Sequence[Sequence[int]]) -> DataFrame:
        """Sets given by places in ``rules``: bounded by the pool."""
        sets = F.array(*[F.array(*[scoring.rule_lit(rules[i]) for i in w]) for w in which])
        return canonical_sets(spark.range(1).select(F.explode(sets).alias("rules")))

    if not rules:
        raise ValueError("no rules to make sets of")
    single = scorer.ruleset_metrics(sets_of([[i] for i in range(len(rules))]), lo_y, hi_y, min_rule_recall).collect()
    stats = {tuple((x["c"], x["lo"], x["hi"]) for x in r["rules"][0]): r for r in single}
    feasible = [r for r in rules if stats[r]["feasible"]]
    if not feasible:  # all sets have the same, worst fitness
        return scorer.ruleset_metrics(sets_of([[0]]), lo_y, hi_y, min_rule_recall)
    rules = feasible
    P = scorer.P[lo_y, hi_y]
    # of the rules from each place on: true positives of their union, least dissimilarity of one
    rest = scorer.ruleset_metrics(sets_of([range(i, len(rules)) for i in range(len(rules))]), lo_y, hi_y).select("n_rules", "tp").collect()
    union = {len(rules) - r["n_rules"]: r["tp"] for r in rest}
    tail = F.array(*[F.lit(union[i]) for i in range(len(rules))], F.lit(0)).cast("array<long>")
    least = [stats[r]["dissimilarity"] for r in rules] + [float("inf")]
    for i in range(len(rules) - 1, -1, -1):
        least[i] = min(least[i], least[i + 1])
    least = F.array(*[F.lit(float(x)) for x in least])
    every = F.array(*[F.struct(F.lit(i).alias("at"), scoring.rule_lit(r).alias("rule")) for i, r in enumerate(rules)])

    def measured(sets: DataFrame) -> DataFrame:
        sets = cut_lineage(canonical_sets(sets))
        got = scorer.ruleset_metrics(sets.select("set_id", "rules"), lo_y, hi_y, min_rule_recall)
        return cut_lineage(got.join(sets.select("set_id", "last"), "set_id"))

    level = measured(spark.range(1).select(F.inline(every)).select(F.array("rule").alias("rules"), F.col("at").alias("last")))
    front = cut_lineage(pareto.pareto_front(level).drop("last"))
    while True:
        top = F.least(F.col("tp") + tail[F.col("last") + 1], F.lit(P))
        bound = level.where(F.col("last") < len(rules) - 1).select(
            "set_id", "rules", "last", (top / (top + F.col("fp"))).alias("fit_p"), (top / F.lit(float(P))).alias("fit_r"),
            (F.col("dissimilarity") + least[F.col("last") + 1]).alias("fit_d"))
        bound = cut_lineage(bound)
        open_ = cut_lineage(bound.join(pareto.dominated(bound, front), "set_id", "left_anti"))
        if open_.isEmpty():
            return front
        grown = open_.select("rules", F.explode(F.filter(every, lambda x: x["at"] > F.col("last"))).alias("x"))
        level = measured(grown.select(F.array_append("rules", F.col("x.rule")).alias("rules"), F.col("x.at").alias("last")))
        front = cut_lineage(pareto.pareto_front(front.unionByName(level.select(front.columns))))


def _boxes(width: float) -> list[Column]:
    """The box of a set: ``width`` wide in precision and recall, that share apart in dissimilarity."""
    near = F.when(F.col("fit_d") > 0, F.log("fit_d")).otherwise(F.lit(0.0)) / F.lit(math.log1p(width))
    far = F.lit(float("inf"))
    return [F.ceil(F.col("fit_p") / F.lit(width)).cast("double").alias("b_p"), F.ceil(F.col("fit_r") / F.lit(width)).cast("double").alias("b_r"),
            F.when(F.col("fit_d") == far, far).otherwise(F.greatest(F.floor(near), F.lit(0)).cast("double")).alias("b_d")]


def _archive(old: DataFrame | None, new: DataFrame, width: float) -> DataFrame:
    """The archive after ``new`` sets: the boxes that no other box dominates, one set each. A set takes the place of
    the one in its box only if it dominates that one, so every change is a gain and there are finitely many."""
    box = ["b_p", "b_r", "b_d"]
    both = new.withColumn("held", F.lit(False))
    if old is not None:
        both = old.withColumn("held", F.lit(True)).unionByName(both)
    placed = cut_lineage(both.where("feasible").select("*", *_boxes(width)))
    open_ = pareto.pareto_front(placed.select(F.concat_ws("/", *box).alias("set_id"), F.col("b_p").alias("fit_p"),
                                              F.col("b_r").alias("fit_r"), F.col("b_d").alias("fit_d")).distinct())
    inside = placed.join(open_.toDF("at", *box), box)
    # the one held, if any, and the best of those that dominate it (or of all) by a total order
    kept = inside.groupBy(*box).agg(F.min_by(F.struct("fit_p", "fit_r", "fit_d"), F.when(F.col("held"), F.col("set_id"))).alias("h"))
    gains = ((F.col("fit_p") >= F.col("h.fit_p")) & (F.col("fit_r") >= F.col("h.fit_r")) & (F.col("fit_d") <= F.col("h.fit_d"))
             & (F.struct("fit_p", "fit_r", "fit_d") != F.col("h")))
    rival = inside.join(kept, box).where(F.col("held") | F.col("h").isNull() | gains)
    order = F.struct((-F.col("fit_p")).alias("p"), (-F.col("fit_r")).alias("r"), F.col("fit_d").alias("d"), "set_id")
    best = rival.groupBy(*box).agg(F.min_by(F.struct(*new.columns), order).alias("x"))
    return cut_lineage(best.select("x.*"))


def beam_ruleset(cube: DataFrame, space: Space, width: float = 0.1, lo_y: int = 0, hi_y: int = 1) -> DataFrame:
    """Rule-set search under (precision max, recall max, dissimilarity min), to a fixed point.

    Start: every condition of the space as a set of one rule. The archive divides the objectives into
    boxes (``width`` wide; dissimilarity by its logarithm) and holds one set for each box that no other box
    dominates: all sets scored so far are within a box of some set of it, and it has at most ``(1 + 1/width)^2``
    sets. Round: neighbours of the archive's sets that have not been expanded, and recombinations of these,
    minus everything already scored, scored in one job. A set enters only into a box that is better or if it
    dominates the one there, so the archive cannot change for ever; the search ends when all of its sets have
    been expanded. Returns the archive.
    """
    spark = cube.sparkSession
    scorer = scoring.Scorer.for_space(cube, space, [(lo_y, hi_y)])
    conds = condition_list(space)
    new = cut_lineage(scorer.ruleset_metrics(single_condition_sets(spark, conds), lo_y, hi_y))
    seen, expanded, front = [new.select("set_id")], [], _archive(None, new, width)
    while True:
        fresh = front.select("set_id", "rules")
        if expanded:
            fresh = fresh.join(_all_of(expanded), "set_id", "left_anti")
        fresh = cut_lineage(fresh)
        if fresh.isEmpty():
            return front
        expanded.append(fresh.select("set_id"))
        cand = (ruleset_neighbours(fresh, space, conds).select("set_id", "rules")
                .unionByName(recombine_sets(fresh).select("set_id", "rules"))
                .dropDuplicates(["set_id"])
                .join(_all_of(seen), "set_id", "left_anti"))
        # written first: the generation plan is large, and scoring reads it more than once
        new = cut_lineage(scorer.ruleset_metrics(cut_lineage(cand), lo_y, hi_y))
        seen.append(new.select("set_id"))
        front = _archive(front, new.select(front.columns), width)
