"""Rule and rule-set scoring, all candidates in one job.

A *condition* is ``struct<c int, lo int, hi int>``: column position ``c`` and threshold indexes,
meaning ``t_lo <= x < t_hi``, i.e. bucket ``lo < b <= hi``. A *rule* is an array of conditions on
distinct columns, sorted by ``c`` (empty = matches every trace). A *rule set* is an array of rules
(their disjunction).

Rules are counted by corner sums (:mod:`spanrules.operators.corners`): a rule looks up ``2^k`` places of the
summed-area table of its column set. Rules on so many columns that the table would not be small are counted
by a bitmap index (:mod:`spanrules.operators.bitmaps`), over the cells of the cube or, where the cube saves
nothing, over the traces (:func:`scorer_for` measures that). Rule sets are counted by inclusion and
exclusion over the meets of their rules, which are rules again; a meet that many sets share is counted
once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanrules.functions.columns import fmeasure, harmonic3, literal_frame, r6, safe_div, sq_dev
from spanrules.operators.bitmaps import BitmapIndex
from spanrules.operators.corners import area_table, corner_counts, grid_cells, meets, table_bytes
from spanrules.operators.cube import Space, bucket_cube, bucket_rows, colset_key, positive
from spanrules.session import cut_lineage

COND_TYPE = "struct<c:int,lo:int,hi:int>"
RULE_TYPE = f"array<{COND_TYPE}>"
BROADCAST_BYTES = 16 << 20
GRID_CELLS = 1 << 16  # places of one column set's table; rules on wider sets are counted by bitmaps


def cond(c, lo, hi) -> Column:
    return F.struct(F.lit(int(c)).alias("c"), F.lit(int(lo)).alias("lo"), F.lit(int(hi)).alias("hi"))


def rule_lit(conds: Sequence[tuple[int, int, int]]) -> Column:
    if not conds:
        return F.array().cast(RULE_TYPE)
    return F.array_sort(F.array(*[cond(*x) for x in conds])).cast(RULE_TYPE)


def rule_key(rule: Column) -> Column:
    """Canonical text of a rule: ``c:lo:hi`` per condition, sorted, joined by ``;``."""
    return F.array_join(F.transform(F.array_sort(rule),
                                    lambda x: F.concat_ws(":", x["c"], x["lo"], x["hi"])), ";")


def set_key(rules: Column) -> Column:
    return F.array_join(F.transform(rules, rule_key), "|")


def rule_colset(rule: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(rule), lambda x: x["c"].cast("string")), ",")


def rule_text(rule: Column, cols: Sequence[str], thresholds: dict[str, list[float]]) -> Column:
    """Readable rule, e.g. ``svc_A_avg_self_dur in [34.0, 52.0) AND ...``."""
    names = F.array(*[F.lit(c) for c in cols])
    ths = F.array(*[F.array(*[F.lit(float(t)) for t in thresholds[c]]) for c in cols])
    return F.array_join(F.transform(F.array_sort(rule), lambda x: F.format_string(
        "%s in [%s, %s)", names[x["c"]], ths[x["c"]][x["lo"]], ths[x["c"]][x["hi"]])), " AND ")


def _colsets(df: DataFrame, cs: str = "cs") -> list[tuple[int, ...]]:
    """Distinct column sets used by the candidates (bounded by the column subsets, small)."""
    out = []
    for r in df.select(cs).distinct().collect():
        out.append(tuple(int(p) for p in r[0].split(",")) if r[0] else ())
    return out


def interval_array(intervals: Sequence[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(int(j)).alias("j"), F.lit(int(i)).alias("i")) for j, i in intervals])


def positives_per_interval(cube: DataFrame, intervals: Sequence[tuple[int, int]]) -> DataFrame:
    """``(j, i, P)``: number of traces with target in ``(s_j, s_i]``."""
    iv = interval_array(intervals)
    got = (cube.select(F.explode(F.filter(iv, lambda v: (v["j"] < F.col("yb")) & (F.col("yb") <= v["i"])))
                       .alias("v"), "n")
               .groupBy(F.col("v.j").alias("j"), F.col("v.i").alias("i"))
               .agg(F.sum("n").cast("long").alias("P")))
    spark = cube.sparkSession
    allv = literal_frame(spark, [(int(j), int(i)) for j, i in intervals], "j int, i int")
    return allv.join(got, ["j", "i"], "left").select("j", "i", F.coalesce("P", F.lit(0)).cast("long").alias("P"))


class Scorer:
    """Scores rules and rule sets against one cube.

    Built once per search: it counts the positives of every target interval (one small job, the
    answer is a handful of numbers). The area tables of the column sets that candidates use are
    written once each and kept for later rounds.
    """

    def __init__(self, cube: DataFrame, sizes: Sequence[int] | None = None, n_yb: int | None = None,
                 intervals: Sequence[tuple[int, int]] = ((0, 1),), require_positives: bool = True,
                 grid: int = GRID_CELLS):
        """``sizes``: thresholds per column; ``n_yb``: target buckets; both measured if not given."""
        self.cube = cube
        if sizes is None:  # a row for each column
            top = cube.select(F.posexplode("b").alias("p", "x")).groupBy("p").agg(F.max("x").alias("x")).collect()
            sizes = [r["x"] + 1 for r in sorted(top, key=lambda r: r["p"])]
        if n_yb is None:
            n_yb = 1 + (cube.agg(F.max("yb")).first()[0] or 0)
        self.sizes, self.n_yb, self.grid = list(sizes), n_yb, grid
        self.intervals = [(int(j), int(i)) for j, i in intervals]
        pos = {(r["j"], r["i"]): int(r["P"]) for r in positives_per_interval(cube, self.intervals).collect()}
        self.P = pos
        if require_positives:
            empty = [iv for iv in self.intervals if pos.get(iv, 0) <= 0]
            if empty:
                raise ValueError(f"No positives in target interval(s) {empty}")
        self.pos_frame = literal_frame(cube.sparkSession, [(j, i, pos.get((j, i), 0)) for j, i in self.intervals],
                                       "j int, i int, P long")
        self._tables: list[tuple[set, DataFrame]] = []
        self._index: BitmapIndex | None = None

    @classmethod
    def for_space(cls, cube: DataFrame, space: Space, intervals=((0, 1),), require_positives: bool = True, **options):
        sizes = [len(space.thresholds[c]) for c in space.cols]
        return cls(cube, sizes, len(space.splits) + 1, intervals, require_positives, **options)

    # -------------------------------------------------------------- counts

    def _area(self, colsets: list[tuple[int, ...]]) -> tuple[DataFrame, bool]:
        """The area tables of the column sets, and whether they are small enough to be broadcast."""
        known = set().union(*(have for have, _ in self._tables))
        new = [s for s in colsets if s not in known]
        if new or not self._tables:
            self._tables.append((set(new or [()]), cut_lineage(area_table(self.cube, new, self.sizes))))
        used = [(have, t) for have, t in self._tables if have & set(colsets)] or self._tables[:1]
        table = used[0][1]
        for _, t in used[1:]:
            table = table.unionByName(t)
        held = [s for have, _ in used for s in have]
        return table, table_bytes(held, self.sizes, self.n_yb) <= BROADCAST_BYTES

    def wide(self, colset: Sequence[int]) -> bool:
        """Whether rules on these columns are counted by bitmaps."""
        return grid_cells(colset, self.sizes) > self.grid

    def index(self) -> BitmapIndex:
        if self._index is None:
            self._index = BitmapIndex(self.cube, self.sizes)
        return self._index

    def rule_counts(self, rules: DataFrame, sums: bool = False, sets: list[tuple[int, ...]] | None = None) -> DataFrame:
        """Per (rule, target bucket): ``n, s1, s2`` of the traces the rule matches.

        ``rules`` needs ``rule_id`` and ``rule``; a candidate that occurs twice counts its traces once. Each
        rule has a row with ``yb = NULL, n = 0`` or rows that add up to its traces. ``s1, s2`` are null for
        rules counted by bitmaps; ``sums=True`` takes the area tables for all rules. ``sets``: the column sets that
        the rules use, where they are known.
        """
        rules = (rules.select("rule_id", "rule").dropDuplicates(["rule_id"])
                 .withColumn("cs", rule_colset(F.col("rule"))))
        sets = _colsets(rules) if sets is None else sets
        wide = [s for s in sets if self.wide(s) and not sums]
        if not wide:
            return corner_counts(rules, self.sizes, *self._area(sets))
        names = [colset_key(s) for s in wide]
        is_wide = F.array_contains(F.array(*[F.lit(x) for x in names]), F.col("cs"))
        of_wide = self.index().counts(rules.where(is_wide))
        none = F.lit(None)
        out = (rules.where(is_wide).select("rule_id", none.cast("int").alias("yb"), F.lit(0).cast("long").alias("n"))
               .unionByName(of_wide).withColumn("s1", none.cast("double")).withColumn("s2", none.cast("double")))
        narrow = [s for s in sets if s not in wide]
        if narrow:
            out = out.unionByName(corner_counts(rules.where(~is_wide), self.sizes, *self._area(narrow)))
        return out

    def score(self, rules: DataFrame) -> DataFrame:
        """Precision, recall and F-measure of every rule for every target interval.

        ``rules``: ``rule_id, rule`` (+ any other columns, kept). Interval ``(j, i)`` labels
        positive the traces with ``j < yb <= i``. Output per (rule, interval): ``tp, fp, support,
        P, precision, recall, fmeasure``. The empty rule scores ``P`` true and ``N`` false
        positives.
        """
        # per rule, its counts by target bucket (at most #splits + 2 entries) in one small
        # array: support and the true positives of every interval come from it in one pass
        per_rule = (self.rule_counts(rules)
                    .groupBy("rule_id")
                    .agg(F.sum("n").cast("long").alias("support"),
                         F.collect_list(F.when(F.col("yb").isNotNull(), F.struct("yb", "n"))).alias("h")))
        iv = interval_array(self.intervals)
        grid = per_rule.select("rule_id", "support", "h", F.explode(iv).alias("v"))
        tp = F.aggregate(F.filter("h", lambda x: (F.col("v.j") < x["yb"]) & (x["yb"] <= F.col("v.i"))),
                         F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
        m = (grid.select("rule_id", "support", F.col("v.j").alias("j"), F.col("v.i").alias("i"),
                         tp.alias("tp"))
                 .join(F.broadcast(self.pos_frame), ["j", "i"])
                 .withColumn("fp", (F.col("support") - F.col("tp")).cast("long"))
                 .withColumn("precision", safe_div(F.col("tp").cast("double"), F.col("support").cast("double")))
                 .withColumn("recall", safe_div(F.col("tp").cast("double"), F.col("P").cast("double")))
                 .withColumn("fmeasure", fmeasure(F.col("precision"), F.col("recall"))))
        return rules.join(m, "rule_id")

    # -------------------------------------------------------------- rule sets

    def ruleset_metrics(self, sets: DataFrame, lo_y: int = 0, hi_y: int = 1,
                        min_rule_recall: float = 0.05) -> DataFrame:
        """Precision, recall, disjointness, dissimilarity, F, harmonic mean, feasibility, fitness.

        * recall / precision of the union of the rules;
        * disjointness = traces matched by exactly one rule / matches counted with multiplicity;
        * dissimilarity = sum over rules of the squared deviations of the target of every trace
          the rule matches (positives and negatives);
        * feasible = every rule alone has recall > ``min_rule_recall``; fitness = ``(precision,
          recall, dissimilarity)`` if feasible else ``(0, 0, inf)``.

        With ``N(M)`` the traces in the meet of ``m`` rules of the set, the union has ``sum (-1)^(m+1) N(M)``
        traces and ``sum (-1)^(m+1) m N(M)`` of them match exactly one rule.
        """
        P = self.P.get((lo_y, hi_y))
        if P is None:
            P = positives_per_interval(self.cube, [(lo_y, hi_y)]).collect()[0]["P"]
        if P <= 0:
            raise ValueError("No positives in the target interval")
        s = sets.dropDuplicates(["set_id"]).select("set_id", "rules")
        met = (s.select("set_id", F.explode(meets(F.col("rules"), RULE_TYPE)).alias("x"))
               .select("set_id", F.col("x.rule").cast(RULE_TYPE).alias("rule"), F.col("x.m").alias("m"))
               .withColumn("rule_id", rule_key(F.col("rule"))))
        pos = positive(F.col("yb"), lo_y, hi_y)
        used = _colsets(met.select(rule_colset(F.col("rule")).alias("cs")))
        stats = cut_lineage(self.rule_counts(met, sets=used).groupBy("rule_id").agg(
            F.sum("n").cast("long").alias("n_r"), F.sum(F.when(pos, F.col("n")).otherwise(F.lit(0))).cast("long").alias("tp_r"),
            F.sum("s1").alias("s1_r"), F.sum("s2").alias("s2_r")))
        sign = F.when(F.col("m") % 2 == 1, F.lit(1)).otherwise(F.lit(-1))
        per_set = met.select("set_id", "rule_id", "m").join(stats, "rule_id").groupBy("set_id").agg(
            F.sum(sign * F.col("tp_r")).cast("long").alias("tp"),
            F.sum(sign * (F.col("n_r") - F.col("tp_r"))).cast("long").alias("fp"),
            F.sum(sign * F.col("m") * F.col("n_r")).cast("long").alias("uniq"),
            F.sum(F.when(F.col("m") == 1, F.col("n_r"))).cast("long").alias("tot"))
        single = (s.select("set_id", F.posexplode("rules").alias("r", "rule"))
                  .withColumn("rule", F.col("rule").cast(RULE_TYPE)).withColumn("rule_id", rule_key(F.col("rule"))))
        if any(self.wide(x) for x in used):
            sums = self.rule_counts(single, sums=True).groupBy("rule_id").agg(F.sum("s1").alias("s1_r"), F.sum("s2").alias("s2_r"))
            stats = stats.drop("s1_r", "s2_r").join(sums, "rule_id", "left")
        # summed in sorted order, so the result does not depend on shuffle arrival order
        dev = F.array_sort(F.collect_list(sq_dev(F.col("n_r").cast("double"), F.col("s1_r"), F.col("s2_r"))))
        per_rule = single.drop("rule").join(stats, "rule_id").groupBy("set_id").agg(
            F.aggregate(dev, F.lit(0.0), lambda acc, x: acc + x).alias("dissimilarity"),
            F.min(F.col("tp_r") / F.lit(float(P))).alias("min_rule_recall"),
            F.sort_array(F.collect_list(F.struct("r", "n_r"))).alias("sizes"))
        out = (s.join(per_set, "set_id").join(per_rule, "set_id")
                      .withColumn("n_rules", F.size("rules"))
                      .withColumn("recall", F.col("tp") / F.lit(float(P)))
                      .withColumn("precision", safe_div(F.col("tp").cast("double"),
                                                        (F.col("tp") + F.col("fp")).cast("double")))
                      .withColumn("disjointness", safe_div(F.col("uniq").cast("double"),
                                                           F.col("tot").cast("double")))
                      .withColumn("fscore", fmeasure(F.col("precision"), F.col("recall")))
                      .withColumn("harmonic", harmonic3(F.col("precision"), F.col("recall"),
                                                        F.col("disjointness")))
                      .withColumn("feasible", F.col("min_rule_recall") > F.lit(min_rule_recall))
                      .withColumn("sizes", F.transform("sizes", lambda x: x["n_r"])))
        inf = F.lit(float("inf"))
        return (out.withColumn("fit_p", F.when(F.col("feasible"), F.col("precision")).otherwise(F.lit(0.0)))
                   .withColumn("fit_r", F.when(F.col("feasible"), F.col("recall")).otherwise(F.lit(0.0)))
                   .withColumn("fit_d", F.when(F.col("feasible"), F.col("dissimilarity")).otherwise(inf)))


def scorer_for(traces: DataFrame, space: Space, intervals: Sequence[tuple[int, int]] = ((0, 1),),
               require_positives: bool = True) -> Scorer:
    """A scorer of the traces: over their cube, or, where nearly every trace has a cell of its own (a
    measured share of more than a half), over the traces, with rules of several conditions by bitmaps."""
    rows = cut_lineage(bucket_rows(traces, space))
    cells, n = rows.agg(F.approx_count_distinct(F.xxhash64("b", "yb")), F.count(F.lit(1))).first()
    if cells * 2 <= n:
        return Scorer.for_space(cut_lineage(bucket_cube(traces, space)), space, intervals, require_positives)
    return Scorer.for_space(rows, space, intervals, require_positives, grid=max(len(space.thresholds[c]) for c in space.cols))


def rule_counts(cube: DataFrame, rules: DataFrame) -> DataFrame:
    return Scorer(cube, require_positives=False).rule_counts(rules)


def score_rules(cube: DataFrame, rules: DataFrame,
                intervals: Sequence[tuple[int, int]] = ((0, 1),),
                require_positives: bool = True, space=None) -> DataFrame:
    """Scores ``rules`` for every interval (see :meth:`Scorer.score`); raises without positives."""
    if space is not None:
        sc = Scorer.for_space(cube, space, intervals, require_positives)
    else:
        sc = Scorer(cube, intervals=intervals, require_positives=require_positives)
    return sc.score(rules)


def best_per_interval(scored: DataFrame, by: Sequence[str] = ("j", "i")) -> DataFrame:
    """Best rule per group: highest F, then fewest conditions, then smallest rule key.

    One ``min_by`` aggregate with a total order, so partial aggregation keeps one row per group
    and map task before the shuffle.
    """
    order = F.struct((-F.col("fmeasure")).alias("f"), F.size("rule").alias("s"),
                     F.col("rule_id").alias("k"))
    keep = [c for c in scored.columns if c not in by]
    return (scored.groupBy(*by).agg(F.min_by(F.struct(*keep), order).alias("best"))
                  .select(*by, "best.*"))


# ---------------------------------------------------------------- rule sets

def ruleset_metrics(cube: DataFrame, sets: DataFrame, lo_y: int = 0, hi_y: int = 1,
                    min_rule_recall: float = 0.05, space=None) -> DataFrame:
    """Rule-set metrics (see :meth:`Scorer.ruleset_metrics`)."""
    if space is not None:
        sc = Scorer.for_space(cube, space, [(lo_y, hi_y)])
    else:
        sc = Scorer(cube, intervals=[(lo_y, hi_y)])
    return sc.ruleset_metrics(sets, lo_y, hi_y, min_rule_recall)


def round_metrics(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[r6(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])
