"""Registered queries: each takes ``(spark, data_dir)`` and returns a DataFrame.

All of them start from the span table that Spark derives from ``orders`` and ``lineitem`` of
the data folder, so their work grows with the tables. ``spans_interval`` and ``root_experiments`` scan
the interval ``WINDOW``, the others the whole time range. Each query builds the trace matrix that it
analyses anew, so it answers for the tables as they are.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanrules.operators import cube as cube_ops
from spanrules.operators import forest, meanshift, pareto, reshape, scoring, search, segment
from spanrules.operators import space as space_ops
from spanrules.operators.thresholds import exact_quantiles, rule_columns, space_summary, thresholds_frame
from spanrules.session import cut_lineage, scratch_path
from spanrules.sources.span_dump import read_dump, write_dump
from spanrules.sources.spans import root_experiments, spans_by_interval
from spanrules.sources.tables import spans_table

# A part of the time range of the fixture (its orders fall in 1995-2001).
WINDOW = (dt.datetime(1996, 3, 1), dt.datetime(1998, 10, 31, 12))

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def spans(spark: SparkSession, data_dir: str) -> DataFrame:
    return spans_by_interval(spans_table(spark, data_dir), None, None)


def staged_spans(spark: SparkSession, data_dir: str, service=("l_returnflag",)) -> DataFrame:
    """The span table, derived and written once, for queries that scan it for servers, calls, roots and names."""
    return cut_lineage(spans_table(spark, data_dir, service))


@register("spans_interval")
def q_spans_interval(spark, data_dir):
    return spans_by_interval(spans_table(spark, data_dir), *WINDOW)


@register("dump_interval")
def q_dump_interval(spark, data_dir):
    """Server spans of the interval, read back from a dump of the whole span table with both filters pushed."""
    path = scratch_path(spark, f"dump-{uuid.uuid4().hex}")
    write_dump(spans_table(spark, data_dir), path)
    return reshape.server_spans(spans_by_interval(read_dump(spark, path), *WINDOW))


@register("root_experiments")
def q_root_experiments(spark, data_dir):
    return root_experiments(spans_table(spark, data_dir), *WINDOW)


@register("clients_duration")
def q_clients_duration(spark, data_dir):
    return reshape.clients_duration(spans(spark, data_dir))


@register("self_duration")
def q_self_duration(spark, data_dir):
    return reshape.self_duration(spans(spark, data_dir))


@register("avg_per_endpoint")
def q_avg_per_endpoint(spark, data_dir):
    return reshape.avg_per_endpoint(reshape.self_duration(spans(spark, data_dir)))


@register("sum_per_endpoint")
def q_sum_per_endpoint(spark, data_dir):
    return reshape.sum_per_endpoint(spans(spark, data_dir))


@register("avg_trace_matrix")
def q_avg_trace_matrix(spark, data_dir):
    return reshape.avg_trace_matrix(staged_spans(spark, data_dir), None, None)


@register("sum_trace_matrix")
def q_sum_trace_matrix(spark, data_dir):
    return reshape.sum_trace_matrix(staged_spans(spark, data_dir), None, None)


# ------------------------------------------------------------------ rule space and scoring


TARGET = "checkout_avg_dur"
QUANTILES = (0.0, 0.25, 0.5, 0.75)


def trace_matrix(spark: SparkSession, data_dir: str) -> DataFrame:
    """The average trace matrix of ``data_dir``, written once for all jobs of a query."""
    return cut_lineage(reshape.avg_trace_matrix(staged_spans(spark, data_dir), None, None))


class Context:
    """Trace matrix (written once, read by every job of a query), rule space and cube."""

    def __init__(self, spark: SparkSession, data_dir: str, quantiles=QUANTILES):
        self.spark = spark
        self.traces = trace_matrix(spark, data_dir)
        self.cols = rule_columns(self.traces)
        self.target = TARGET
        th, (median,), top = space_summary(self.traces, self.cols, quantiles, TARGET, [0.5])
        self.space = cube_ops.Space(tuple(self.cols), th, TARGET, (median, top))
        self.cube = cut_lineage(cube_ops.bucket_cube(self.traces, self.space))

    def conds(self, feasible_only=False):
        return space_ops.condition_list(self.space, feasible_only=feasible_only)

    def rules(self):
        """Rules of any number of conditions, one per column."""
        return space_ops.rules_up_to(self.spark, self.conds(), len(self.cols))


METRIC_COLS = ("precision", "recall", "fmeasure")


def _scored_view(scored: DataFrame) -> DataFrame:
    out = scored.select("rule_id", F.size("rule").alias("n_conds"), "tp", "fp", "support",
                        *METRIC_COLS)
    return scoring.round_metrics(out, METRIC_COLS)


@register("quantile_thresholds")
def q_quantile_thresholds(spark, data_dir):
    ctx = Context(spark, data_dir)
    return thresholds_frame(spark, ctx.space.thresholds, ctx.cols)


@register("label_counts")
def q_label_counts(spark, data_dir):
    return cube_ops.label_counts(Context(spark, data_dir).cube)


@register("threshold_counts")
def q_threshold_counts(spark, data_dir):
    ctx = Context(spark, data_dir)
    return cube_ops.threshold_counts(ctx.cube, ctx.space)


@register("bucket_cube")
def q_bucket_cube(spark, data_dir):
    c = Context(spark, data_dir).cube
    return c.select(F.array_join("b", ",").alias("b"), "yb", "n", "s1", "s2")


@register("condition_space")
def q_condition_space(spark, data_dir):
    ctx = Context(spark, data_dir)
    return space_ops.condition_space(spark, ctx.space)


@register("rule_decode")
def q_rule_decode(spark, data_dir):
    ctx = Context(spark, data_dir)
    th = F.array(*[F.array(*[F.lit(float(t)) for t in ctx.space.thresholds[c]]) for c in ctx.cols])
    names = F.array(*[F.lit(c) for c in ctx.cols])
    return (ctx.rules().select("rule_id", F.explode("rule").alias("x"))
               .select("rule_id", names[F.col("x.c")].alias("col"),
                       th[F.col("x.c")][F.col("x.lo")].alias("t_lo"),
                       th[F.col("x.c")][F.col("x.hi")].alias("t_hi")))


@register("rule_metrics")
def q_rule_metrics(spark, data_dir):
    ctx = Context(spark, data_dir)
    return _scored_view(scoring.score_rules(ctx.cube, ctx.rules(), space=ctx.space))


WIDE_SERVICE = ("l_returnflag", "l_linestatus", "l_linenumber")


def wide_traces(spark: SparkSession, data_dir: str) -> DataFrame:
    """A row per trace and a column per service told by flag, status and line number: its average time (ms),
    null where a trace does not reach it."""
    servers = reshape.server_spans(spans_by_interval(staged_spans(spark, data_dir, WIDE_SERVICE), None, None))
    return cut_lineage(reshape.round_to_millis(reshape.pivot_by_trace(servers, [("duration", "avg", "_avg_dur")])))


@register("wide_rule_metrics")
def q_wide_rule_metrics(spark, data_dir):
    """Rules of one and two adjacent-bin conditions over more columns than a cube can group by."""
    t = wide_traces(spark, data_dir)
    cols = [c for c in rule_columns(t, "_avg_dur") if c != TARGET]
    th, (median,), top = space_summary(t, cols, QUANTILES, TARGET, [0.5])
    space = cube_ops.Space(tuple(cols), th, TARGET, (median, top))
    rules = space_ops.rules_up_to(spark, space_ops.bin_feature_list(space), 2)
    return _scored_view(scoring.scorer_for(t, space).score(rules))


@register("bin_features")
def q_bin_features(spark, data_dir):
    ctx = Context(spark, data_dir)
    feats = set(space_ops.bin_feature_list(ctx.space))
    cs = space_ops.condition_space(spark, ctx.space)
    keep = F.array(*[F.lit(f"{c}:{lo}:{hi}") for c, lo, hi in sorted(feats)])
    return (cs.filter(F.array_contains(keep, F.concat_ws(":", "c", "lo", "hi")))
              .select("c", "col", "lo", "hi", "t_lo", "t_hi"))


@register("bin_features_scored")
def q_bin_features_scored(spark, data_dir):
    ctx = Context(spark, data_dir)
    rules = space_ops.rules_up_to(spark, space_ops.bin_feature_list(ctx.space), 1)
    return _scored_view(scoring.score_rules(ctx.cube, rules, space=ctx.space))


# ------------------------------------------------------------------ rule sets, Pareto


SET_METRICS = ("precision", "recall", "disjointness", "dissimilarity", "fscore", "harmonic",
               "fit_p", "fit_r", "fit_d")


def _pair_set_metrics(ctx: Context) -> DataFrame:
    sets = space_ops.pair_sets(ctx.spark, space_ops.bin_feature_list(ctx.space))
    return scoring.ruleset_metrics(ctx.cube, sets, space=ctx.space)


@register("ruleset_metrics")
def q_ruleset_metrics(spark, data_dir):
    m = _pair_set_metrics(Context(spark, data_dir))
    out = m.select("set_id", "n_rules", "tp", "fp", *SET_METRICS, "feasible")
    return scoring.round_metrics(out, SET_METRICS)


@register("ruleset_sizes")
def q_ruleset_sizes(spark, data_dir):
    m = _pair_set_metrics(Context(spark, data_dir))
    return m.select("set_id", F.posexplode("sizes").alias("r", "size"))


FRONT_QUANTILES = (0.0, 0.2, 0.4, 0.6, 0.8)


def _front(spark, data_dir) -> DataFrame:
    """Front of all sets of one or two rules of one condition each."""
    ctx = Context(spark, data_dir, FRONT_QUANTILES)
    m = cut_lineage(scoring.ruleset_metrics(ctx.cube, space_ops.pair_sets(spark, ctx.conds()), space=ctx.space))
    return pareto.pareto_front(m.select("set_id", "precision", "recall", "dissimilarity",
                                        "fit_p", "fit_r", "fit_d"))


@register("ruleset_front")
def q_ruleset_front(spark, data_dir):
    ctx = Context(spark, data_dir)
    front = search.ruleset_front(ctx.cube, ctx.space)
    out = front.select("set_id", "n_rules", "tp", "fp", "fit_p", "fit_r", F.round("fit_d", 2).alias("fit_d"))
    return scoring.round_metrics(out, ("fit_p", "fit_r"))


@register("pareto_front")
def q_pareto_front(spark, data_dir):
    return scoring.round_metrics(_front(spark, data_dir).select("set_id", "fit_p", "fit_r", "fit_d"),
                                 ("fit_p", "fit_r", "fit_d"))


@register("pareto_crowding")
def q_pareto_crowding(spark, data_dir):
    c = pareto.crowding_distance(_front(spark, data_dir))
    return scoring.round_metrics(c.select("set_id", "fit_p", "fit_r", "fit_d", "crowding"),
                                 ("fit_p", "fit_r", "fit_d", "crowding"))


@register("beta_best")
def q_beta_best(spark, data_dir):
    b = pareto.beta_best(_front(spark, data_dir))
    return scoring.round_metrics(b.select("set_id", "precision", "recall", "dissimilarity", "beta"),
                                 ("precision", "recall", "dissimilarity", "beta"))


# ------------------------------------------------------------------ searches, segmentation


SEG_QUANTILES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)


def _best_view(best: DataFrame) -> DataFrame:
    out = best.select("rule_id", F.size("rule").alias("n_conds"), "tp", "fp", "support", *METRIC_COLS)
    return scoring.round_metrics(out, METRIC_COLS)


@register("bnb_best_rule")
def q_bnb_best_rule(spark, data_dir):
    ctx = Context(spark, data_dir)
    return _best_view(search.branch_and_bound(ctx.cube, ctx.space))


@register("best_rule")
def q_best_rule(spark, data_dir):
    ctx = Context(spark, data_dir)
    return _best_view(search.best_rule(ctx.cube, ctx.space))


@register("rule_neighbours")
def q_rule_neighbours(spark, data_dir):
    ctx = Context(spark, data_dir)
    seeds = space_ops.rules_up_to(spark, space_ops.bin_feature_list(ctx.space), 1, include_empty=False)
    return search.rule_neighbours(seeds, ctx.space).select("parent_id", "move", "rule_id")


@register("beam_rule")
def q_beam_rule(spark, data_dir):
    ctx = Context(spark, data_dir)
    best = search.beam_rule(ctx.cube, ctx.space)
    return space_ops.decorate(_best_view(best).join(best.select("rule_id", "rule"), "rule_id"),
                              ctx.space).drop("rule")


def _set_seeds(ctx: Context) -> DataFrame:
    """Sets of one condition (any of the space), and of two bin features of the first two columns, as two rules and
    as one."""
    one = search.single_condition_sets(ctx.spark, ctx.conds())
    bins = space_ops.bin_feature_list(ctx.space)
    f, g = ([x for x in bins if x[0] == c] for c in (0, 1))
    pairs = [(x, y) for x in f for y in g]
    two = [F.array(scoring.rule_lit([x]), scoring.rule_lit([y])) for x, y in pairs]
    both = [F.array(scoring.rule_lit([x, y])) for x, y in pairs]
    more = ctx.spark.range(1).select(F.explode(F.array(*two, *both)).alias("rules"))
    return one.unionByName(search.canonical_sets(more))


@register("ruleset_neighbours")
def q_ruleset_neighbours(spark, data_dir):
    ctx = Context(spark, data_dir)
    return search.ruleset_neighbours(_set_seeds(ctx), ctx.space).select("parent_id", "move", "set_id")


@register("ruleset_recombined")
def q_ruleset_recombined(spark, data_dir):
    ctx = Context(spark, data_dir)
    return search.recombine_sets(_set_seeds(ctx)).select("parent_id", "set_id").distinct()


@register("bnb_support_bound")
def q_bnb_support_bound(spark, data_dir):
    ctx = Context(spark, data_dir)
    return _best_view(search.branch_and_bound(ctx.cube, ctx.space, support_bound=True))


@register("beam_ruleset")
def q_beam_ruleset(spark, data_dir):
    ctx = Context(spark, data_dir)
    front = search.beam_ruleset(ctx.cube, ctx.space)
    return scoring.round_metrics(front.select("set_id", "n_rules", *SET_METRICS), SET_METRICS)


def _splits(ctx: Context) -> list[float]:
    return segment.split_points(ctx.traces, TARGET, SEG_QUANTILES)


@register("segment_intervals")
def q_segment_intervals(spark, data_dir):
    ctx = Context(spark, data_dir)
    return segment.segment_intervals(spark, _splits(ctx))


@register("segment_scores")
def q_segment_scores(spark, data_dir):
    ctx = Context(spark, data_dir)
    return _segments_view(segment.segment_scores(ctx.traces, ctx.space, _splits(ctx)))


@register("segment_best_rules")
def q_segment_best_rules(spark, data_dir):
    """Every interval explained by the best rule of any feasible conditions."""
    ctx = Context(spark, data_dir)
    return _segments_view(segment.segment_scores(ctx.traces, ctx.space, _splits(ctx), explainer="rule"))


def _segments_view(s: DataFrame) -> DataFrame:
    out = s.select("j", "i", "s_from", "s_to", "rule_id", F.size("rule").alias("n_conds"),
                   "tp", "fp", "P", *METRIC_COLS)
    return scoring.round_metrics(out, METRIC_COLS)


@register("segmentation")
def q_segmentation(spark, data_dir):
    ctx = Context(spark, data_dir)
    splits = _splits(ctx)
    scores = cut_lineage(segment.segment_scores(ctx.traces, ctx.space, splits))
    seg = segment.best_segmentation(scores, len(splits))
    out = seg.select("seg", "j", "i", "s_from", "s_to", "rule_id", "fmeasure", "total")
    return scoring.round_metrics(out, ("fmeasure", "total"))


# ------------------------------------------------------------------ mean-shift thresholds


def _matrix(spark, data_dir) -> DataFrame:
    return trace_matrix(spark, data_dir)


@register("value_histogram")
def q_value_histogram(spark, data_dir):
    t = _matrix(spark, data_dir)
    return meanshift.value_histogram(t, rule_columns(t))


@register("bandwidth")
def q_bandwidth(spark, data_dir):
    t = _matrix(spark, data_dir)
    bw = meanshift.bandwidth(meanshift.value_histogram(t, rule_columns(t)))
    return bw.select("col", "n", "k", "bandwidth")


@register("meanshift_modes")
def q_meanshift_modes(spark, data_dir):
    t = _matrix(spark, data_dir)
    hist = cut_lineage(meanshift.value_histogram(t, rule_columns(t)))
    bw = cut_lineage(meanshift.bandwidth(hist))
    shifted = meanshift.shift(hist, bw, meanshift.seeds(hist, bw))
    return meanshift.modes(shifted, bw)


@register("meanshift_thresholds")
def q_meanshift_thresholds(spark, data_dir):
    t = _matrix(spark, data_dir)
    cols = rule_columns(t)
    return thresholds_frame(spark, meanshift.meanshift_thresholds(t, cols), cols)


# ------------------------------------------------------------------ forest predicates


SLA_QUANTILE = 0.2


@register("forest_nodes")
def q_forest_nodes(spark, data_dir):
    t = _matrix(spark, data_dir)
    cols = rule_columns(t)
    sla = exact_quantiles(t, TARGET, [SLA_QUANTILE])[0]
    return forest.grow_forest(t, TARGET, cols, sla)


@register("forest_predicates")
def q_forest_predicates(spark, data_dir):
    t = _matrix(spark, data_dir)
    cols = rule_columns(t)
    sla = exact_quantiles(t, TARGET, [SLA_QUANTILE])[0]
    return scoring.round_metrics(forest.forest_predicates(t, TARGET, cols, sla), ("score",))
