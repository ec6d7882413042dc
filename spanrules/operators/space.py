"""Condition space, bin features and rule growth.

The driver holds the thresholds (one short list per column). Conditions and grown rules are
DataFrames: a rule grows by exploding the literal array of conditions filtered to columns after
its last one, a generator inside one projection, so no candidate table is ever joined with itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanrules.functions.columns import literal_frame
from spanrules.operators.cube import Space
from spanrules.operators.scoring import RULE_TYPE, cond, rule_key, rule_lit, rule_text
from spanrules.operators.thresholds import exact_quantiles, column_max, quantile_thresholds


def make_space(traces: DataFrame, cols: Sequence[str], quantiles: Sequence[float], target: str,
               from_: float, to: float, with_min: bool = False) -> Space:
    th = quantile_thresholds(traces, cols, quantiles, with_min=with_min)
    return Space(tuple(cols), th, target, (float(from_), float(to)))


def median_to_max(traces: DataFrame, target: str, q: float = 0.5) -> tuple[float, float]:
    """Target interval ``(quantile q, max]``, as in the source model's tests."""
    return exact_quantiles(traces, target, [q])[0], column_max(traces, target)


def condition_list(space: Space, feasible_only: bool = False,
                   min_thresholds: int = 0) -> list[tuple[int, int, int]]:
    """All ``(c, lo, hi)`` with ``lo < hi`` (threshold indexes), small (sum of len^2 / 2)."""
    out = []
    for p, c in enumerate(space.cols):
        n = len(space.thresholds[c])
        if n < min_thresholds:
            continue
        for lo in range(n - 1):
            for hi in range(lo + 1, n):
                if feasible_only and lo == 0 and hi == n - 1:
                    continue
                out.append((p, lo, hi))
    return out


def bin_feature_list(space: Space) -> list[tuple[int, int, int]]:
    """Adjacent-threshold conditions ``(c, i, i + 1)``."""
    return [(p, i, i + 1) for p, c in enumerate(space.cols)
            for i in range(len(space.thresholds[c]) - 1)]


def cond_array(conds: Sequence[tuple[int, int, int]]) -> Column:
    if not conds:
        return F.array().cast(f"array<struct<c:int,lo:int,hi:int>>")
    return F.array(*[cond(*x) for x in conds])


def space_frame(spark: SparkSession, space: Space) -> DataFrame:
    """``(pos, col, th array<double>)``: one row per rule column."""
    rows = [(p, c, [float(t) for t in space.thresholds[c]]) for p, c in enumerate(space.cols)]
    return literal_frame(spark, rows, "pos int, col string, th array<double>")


def condition_space(spark: SparkSession, space: Space) -> DataFrame:
    """All conditions ``t_lo <= x < t_hi`` with ``lo < hi``, with their values and feasibility.

    Feasible = the condition does not span the column's whole range. Built from the threshold
    arrays by two generators (``sequence``), not by a self-join.
    """
    s = space_frame(spark, space).filter(F.size("th") >= 2)
    lo = s.select("pos", "col", "th", F.explode(F.sequence(F.lit(0), F.size("th") - 2)).alias("lo"))
    both = lo.select("pos", "col", "th", "lo",
                     F.explode(F.sequence(F.col("lo") + 1, F.size("th") - 1)).alias("hi"))
    return both.select(
        F.col("pos").alias("c"), "col", "lo", "hi",
        F.col("th")[F.col("lo")].alias("t_lo"), F.col("th")[F.col("hi")].alias("t_hi"),
        (~((F.col("lo") == 0) & (F.col("hi") == F.size("th") - 1))).alias("feasible"))


def seed_rules(spark: SparkSession) -> DataFrame:
    """One row holding the empty rule."""
    return spark.range(1).select(rule_lit([]).alias("rule"))


def extend_rules(rules: DataFrame, conds: Sequence[tuple[int, int, int]]) -> DataFrame:
    """Every rule + one condition on a column after the rule's last column."""
    last = F.coalesce(F.array_max(F.transform("rule", lambda x: x["c"])), F.lit(-1))
    grown = rules.select("*", F.explode(F.filter(cond_array(conds), lambda x: x["c"] > last)).alias("_x"))
    return grown.withColumn("rule", F.array_append("rule", F.col("_x")).cast(RULE_TYPE)).drop("_x")


def rules_up_to(spark: SparkSession, conds: Sequence[tuple[int, int, int]], depth: int,
                include_empty: bool = True) -> DataFrame:
    """All rules of at most ``depth`` conditions on distinct columns (``rule_id, rule``)."""
    level = seed_rules(spark)
    parts = [level] if include_empty else []
    for _ in range(depth):
        level = extend_rules(level, conds)
        parts.append(level)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return with_rule_id(out)


def with_rule_id(rules: DataFrame) -> DataFrame:
    return rules.withColumn("rule_id", rule_key(F.col("rule")))


def decorate(rules: DataFrame, space: Space) -> DataFrame:
    """Adds the readable rule text (values instead of indexes)."""
    return rules.withColumn("rule_text", rule_text(F.col("rule"), space.cols, space.thresholds))


def pair_sets(spark: SparkSession, conds: Sequence[tuple[int, int, int]]) -> DataFrame:
    """Rule sets of one or two single-condition rules over ``conds`` (``set_id, rules``).

    Pairs come from a generator over the literal condition array (``g > f`` as structs), so the
    set list is built without a join; its size is ``k + k(k-1)/2`` for ``k`` conditions.
    """
    from spanrules.operators.scoring import set_key
    arr = cond_array(conds)
    base = spark.range(1).select(F.explode(arr).alias("f"))
    singles = base.select(F.array(F.array(F.col("f"))).alias("rules"))
    pairs = (base.select("f", F.explode(F.filter(arr, lambda g: g > F.col("f"))).alias("g"))
                 .select(F.array(F.array(F.col("f")), F.array(F.col("g"))).alias("rules")))
    sets = singles.unionByName(pairs).withColumn("rules", F.col("rules").cast(f"array<{RULE_TYPE}>"))
    return sets.withColumn("set_id", set_key(F.col("rules")))
