"""Rule counts by corner sums: a summed-area table per column set, ``2^k`` lookups per rule.

A rule with conditions on the columns of a set ``S`` is a box of buckets ``lo < b <= hi`` per column. With

    A(S, at) = sum over the traces with 1 <= b_p <= at_p for every p of S,

the traces in the box are the sum of ``A`` at its corners, each with the sign ``(-1)^(number of lower
ends)``. A corner with a lower end of 0 is nothing: bucket 0 is "missing", which no condition matches, and
is left out of the table. So a rule is at most ``2^k`` keys ``(set, at)``, looked up by an equi-join
on the whole key: no rule ever meets the cells of its column set, and no key holds more than one
row of the table.

The table of a set grows axis by axis: a cell counts for all places at or beyond it on one axis, then the
sums are taken (map-side first), so an axis costs half its length in rows, never the square of the
grid. It has ``prod(thresholds - 1)`` places per set, whatever the number of traces; :func:`grid_cells`
is that bound. Counts are whole numbers, so the signs cancel exactly; the sums of the target's deviation and
of its square are about a centre, as in the cube.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanrules.operators.cube import marginals

KEY_BYTES = 48   # of a row of the table, beside its key
AXIS_BYTES = 12  # of an entry of the key


def grid_cells(colset: Sequence[int], sizes: Sequence[int]) -> int:
    """Places of the table of one column set; ``sizes`` are the numbers of thresholds."""
    return prod(max(sizes[p] - 1, 1) for p in colset)


def table_bytes(colsets: Sequence[Sequence[int]], sizes: Sequence[int], n_yb: int) -> int:
    """Most bytes that the tables of the column sets take."""
    return sum(grid_cells(s, sizes) * n_yb * (KEY_BYTES + AXIS_BYTES * (len(s) + 1)) for s in colsets)


def area_table(cube: DataFrame, colsets: Sequence[Sequence[int]], sizes: Sequence[int]) -> DataFrame:
    """``(cs, at array<int>, yb, n, s1, s2)``: sums over ``1 <= b_p <= at_p``, per target bucket."""
    last = _axis_ends(sizes)
    parts = marginals(cube, colsets)
    axis = F.transform(F.filter(F.split("cs", ","), lambda p: p != ""), lambda p: last[p.cast("int")])
    inside = F.forall(F.zip_with("key", axis, lambda b, m: (b >= 1) & (b <= m)), lambda v: v)
    table = parts.where(inside).withColumnRenamed("key", "at")
    for k in range(max((len(s) for s in colsets), default=0)):
        here = F.size("at") > k
        # a cell counts at its own place on axis k and at all beyond it
        beyond = F.when(here, F.sequence(F.get("at", F.lit(k)), F.get(axis, F.lit(k)))).otherwise(F.array(F.lit(-1)))
        grown = table.select("cs", "at", "yb", "n", "s1", "s2", F.explode(beyond).alias("place"))
        at = F.when(F.size("at") > k, F.transform("at", lambda x, i: F.when(i == k, F.col("place")).otherwise(x))).otherwise(F.col("at"))
        table = (grown.withColumn("at", at).groupBy("cs", "at", "yb")
                 .agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2")))
    return table


def _axis_ends(sizes: Sequence[int]) -> Column:
    """The highest place on each column's axis."""
    return F.array(*[F.lit(max(n - 1, 1)) for n in sizes])


def corners(rule: Column, sizes: Sequence[int]) -> Column:
    """``array<struct<at array<int>, sign int>>``: the corners of a rule (conditions sorted by column)
    that are not nothing."""
    last = _axis_ends(sizes)
    kind = "array<struct<at:array<int>,sign:int>>"
    start = F.array(F.struct(F.array().cast("array<int>").alias("at"), F.lit(1).alias("sign"))).cast(kind)

    def grow(acc: Column, x: Column) -> Column:
        high = F.transform(acc, lambda c: F.struct(F.array_append(c["at"], F.least(x["hi"], last[x["c"]])).alias("at"), c["sign"].alias("sign")))
        low = F.transform(acc, lambda c: F.struct(F.array_append(c["at"], F.least(x["lo"], last[x["c"]])).alias("at"), (-c["sign"]).alias("sign")))
        return F.when(x["lo"] > 0, F.concat(high, low)).otherwise(high).cast(kind)

    return F.aggregate(rule, start, grow)


def corner_counts(rules: DataFrame, sizes: Sequence[int], table: DataFrame, broadcast: bool) -> DataFrame:
    """``(rule_id, yb, n, s1, s2)`` of the traces that each rule matches; ``yb`` is null, ``n`` 0, for a rule
    whose corners are all empty. ``rules`` has ``rule_id, rule, cs`` once each; ``broadcast`` sends the
    table to all tasks (its size is known, see :func:`table_bytes`)."""
    asked = (rules.select("rule_id", "cs", F.explode(corners(F.array_sort("rule"), sizes)).alias("c"))
             .select("rule_id", "cs", "c.at", "c.sign"))
    found = asked.join(F.broadcast(table) if broadcast else table, ["cs", "at"], "left")
    return (found.groupBy("rule_id", "yb")
            .agg(F.coalesce(F.sum(F.col("sign") * F.col("n")), F.lit(0)).cast("long").alias("n"),
                 F.coalesce(F.sum(F.col("sign") * F.col("s1")), F.lit(0.0)).alias("s1"),
                 F.coalesce(F.sum(F.col("sign") * F.col("s2")), F.lit(0.0)).alias("s2")))


# ------------------------------------------------------------------ sets of rules


def _cut(a: Column, b: Column) -> Column:
    """The conditions that two rules ask for together, sorted by column."""
    def end(r: Column, c: Column, field: str, none: int) -> Column:
        found = F.get(F.filter(r, lambda x: x["c"] == c), F.lit(0))
        return F.coalesce(found[field], F.lit(none))

    cols = F.array_sort(F.array_union(F.transform(a, lambda x: x["c"]), F.transform(b, lambda x: x["c"])))
    return F.transform(cols, lambda c: F.struct(
        c.alias("c"), F.greatest(end(a, c, "lo", -1), end(b, c, "lo", -1)).alias("lo"),
        F.least(end(a, c, "hi", 1 << 30), end(b, c, "hi", 1 << 30)).alias("hi")))


def meets(rules: Column, rule_type: str) -> Column:
    """All non-empty meets of the rules of a set: ``array<struct<rule, m int>>``, ``m`` = how many rules meet.

    A set of ``r`` rules has at most ``2^r - 1``; rules that exclude each other (as most of a good set do)
    have no meet, and none that would contain it is looked at.
    """
    kind = f"array<struct<rule:{rule_type},m:int>>"

    def grow(acc: Column, r: Column) -> Column:
        both = F.filter(F.transform(acc, lambda x: F.struct(_cut(x["rule"], r).alias("rule"), (x["m"] + 1).alias("m"))),
                        lambda x: F.forall(x["rule"], lambda c: c["lo"] < c["hi"]))
        alone = F.array(F.struct(r.alias("rule"), F.lit(1).alias("m"))).cast(kind)
        return F.concat(acc, alone, both.cast(kind)).cast(kind)

    return F.aggregate(rules, F.array().cast(kind), grow)
