"""Oracle SQL (DuckDB dialect) for the registered queries.

Each statement recomputes its answer from the raw tables by brute force (no bucket cube, no
search): spans from ``orders`` + ``lineitem``, the trace matrix, thresholds with
``quantile_disc``, and then the rule metrics by joining rules with the traces themselves.
The rule columns of the fixture are fixed: the endpoints are ``checkout`` and one service per
TPC-H return flag.
"""

from __future__ import annotations

# Fixed values of the span fixture (see FIXTURES.md).
ENDPOINTS = ["checkout", "svc_A", "svc_N", "svc_R"]
TARGET = "checkout_avg_dur"
RULE_COLS = [f"{e}_avg_self_dur" for e in ENDPOINTS]
FROM_US = 825638400000000      # 1996-03-01 00:00:00 UTC
TO_US = 909835200000000        # 1998-10-31 12:00:00 UTC


def spans_cte() -> str:
    return f"""
lines AS (
  SELECT l.l_orderkey AS k, CAST(l.l_linenumber AS BIGINT) AS ln,
         CAST(round(l.l_extendedprice) AS BIGINT) AS ep, 'svc_' || l.l_returnflag AS name,
         CAST(round(o.o_totalprice) AS BIGINT) AS tp, epoch_us(o.o_orderdate) AS ts,
         o.o_orderpriority AS experiment
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
raw AS (
  SELECT CAST(k AS VARCHAR) AS traceId, 'checkout' AS name, sum(ep) + any_value(tp) AS duration,
         'r' || CAST(k AS VARCHAR) AS id, 'SERVER' AS kind, any_value(ts) AS timestamp,
         CAST(NULL AS VARCHAR) AS parentId, any_value(experiment) AS experiment
  FROM lines GROUP BY k
  UNION ALL
  SELECT CAST(k AS VARCHAR), name, ep + 500, 'c' || CAST(k AS VARCHAR), 'CLIENT', ts + ln,
         'r' || CAST(k AS VARCHAR), CAST(NULL AS VARCHAR) FROM lines
  UNION ALL
  SELECT CAST(k AS VARCHAR), name, ep, 's' || CAST(k AS VARCHAR), 'SERVER', ts + ln,
         'c' || CAST(k AS VARCHAR), CAST(NULL AS VARCHAR) FROM lines),
sp AS (
  SELECT traceId, name AS endpoint, duration, id, kind, timestamp, parentId FROM raw),
roots AS (
  SELECT traceId, experiment FROM raw WHERE parentId IS NULL AND kind = 'SERVER'),
cd AS (
  SELECT parentId, sum(duration) AS clients_duration FROM sp WHERE kind = 'CLIENT' GROUP BY parentId),
selfs AS (
  SELECT s.traceId, s.endpoint, coalesce(s.duration, 0) AS duration, s.id,
         coalesce(s.timestamp, 0) AS timestamp, coalesce(cd.clients_duration, 0) AS clients_duration,
         coalesce(s.duration, 0) - coalesce(cd.clients_duration, 0) AS self_duration
  FROM sp s LEFT JOIN cd ON s.id = cd.parentId WHERE s.kind = 'SERVER')"""


WIDE_SERVICE = ("l_returnflag", "l_linestatus", "l_linenumber")


def wide_ctes() -> str:
    """``tv`` and ``lab`` of the table with a column per service told by flag, status and line number."""
    name = " || '_' || ".join(f"l.{c}::VARCHAR" for c in WIDE_SERVICE)
    return f"""
lines AS (
  SELECT l.l_orderkey AS k, CAST(round(l.l_extendedprice) AS BIGINT) AS ep, 'svc_' || {name} AS name,
         CAST(round(o.o_totalprice) AS BIGINT) AS tp
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
names AS (SELECT name || '_avg_dur' AS col, row_number() OVER (ORDER BY name || '_avg_dur') - 1 AS pos
          FROM (SELECT DISTINCT name FROM lines)),
tv AS (SELECT k AS rid, names.pos, names.col, round(avg(ep) / 1000.0) + 0.0 AS v
       FROM lines JOIN names ON names.col = lines.name || '_avg_dur' GROUP BY k, names.pos, names.col),
qs AS (SELECT pos, col, list_sort(list_distinct(list_append(quantile_disc(v, [0.0, 0.25, 0.5, 0.75]), max(v) + 1))) AS th
       FROM tv GROUP BY pos, col),
thr AS (SELECT pos, col, unnest(th) AS t, generate_subscripts(th, 1) - 1 AS i, len(th) AS nth FROM qs),
target AS (SELECT k AS rid, round((sum(ep) + any_value(tp)) / 1000.0) + 0.0 AS y FROM lines GROUP BY k),
iv AS (SELECT quantile_disc(y, 0.5) AS fr, max(y) AS tt FROM target),
lab AS (SELECT rid, y, (y > iv.fr AND y <= iv.tt) AS pos FROM target, iv),
conds AS (
  SELECT a.pos AS c, a.col, a.i AS lo, b.i AS hi, a.t AS t_lo, b.t AS t_hi,
         NOT (a.i = 0 AND b.i = a.nth - 1) AS feasible
  FROM thr a JOIN thr b ON a.pos = b.pos AND a.i < b.i)"""


def _matrix_cte() -> str:
    cols, notnull = [], []
    for e in ENDPOINTS:
        for src, suf in (("self_duration", "_avg_self_dur"), ("duration", "_avg_dur")):
            # + 0.0 turns DuckDB's -0.0 into 0.0, as Spark's round gives
            cols.append(f"round(avg(CASE WHEN endpoint = '{e}' THEN {src} END) / 1000.0) + 0.0 AS {e}{suf}")
            notnull.append(f"{e}{suf} IS NOT NULL")
    return f"""
wide AS (SELECT traceId, {', '.join(cols)} FROM selfs GROUP BY traceId),
traces AS (
  SELECT w.*, r.experiment FROM wide w JOIN roots r USING (traceId)
  WHERE {' AND '.join(notnull)})"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def base_ctes() -> str:
    return with_(spans_cte(), _matrix_cte())


def reshape_sql() -> dict[str, str]:
    sums = ", ".join(f"round(sum(CASE WHEN endpoint = '{e}' THEN duration END) / 1000.0) + 0.0 AS {e}"
                     for e in ENDPOINTS)
    sum_nn = " AND ".join(f"{e} IS NOT NULL" for e in ENDPOINTS)
    head = with_(spans_cte())
    return {
        "spans_interval": f"{head} SELECT * FROM sp WHERE timestamp BETWEEN {FROM_US} AND {TO_US}",
        "dump_interval": f"""{head} SELECT traceId, endpoint, duration, id, timestamp FROM sp
            WHERE timestamp BETWEEN {FROM_US} AND {TO_US} AND kind = 'SERVER'""",
        "root_experiments": f"""{head} SELECT traceId, experiment FROM raw
            WHERE timestamp BETWEEN {FROM_US} AND {TO_US} AND parentId IS NULL AND kind = 'SERVER'""",
        "clients_duration": f"{head} SELECT * FROM cd",
        "self_duration": f"{head} SELECT * FROM selfs",
        "avg_per_endpoint": f"""{head} SELECT traceId, endpoint, avg(duration) AS avg_duration,
            avg(self_duration) AS avg_self_duration FROM selfs GROUP BY traceId, endpoint""",
        "sum_per_endpoint": f"""{head} SELECT traceId, endpoint, sum(duration) AS duration
            FROM sp WHERE kind = 'SERVER' GROUP BY traceId, endpoint""",
        "avg_trace_matrix": f"{base_ctes()} SELECT * FROM traces",
        "sum_trace_matrix": f"""{head},
            w AS (SELECT traceId, {sums} FROM sp WHERE kind = 'SERVER' GROUP BY traceId)
            SELECT w.*, r.experiment FROM w JOIN roots r USING (traceId) WHERE {sum_nn}""",
    }


# ------------------------------------------------------------------ rule space and scoring

QUANTILES = (0.0, 0.25, 0.5, 0.75)


def space_ctes(quantiles=QUANTILES) -> str:
    """Unpivoted traces, thresholds, target interval (median, max] and conditions."""
    tv = " UNION ALL ".join(
        f"SELECT rid, {p} AS pos, '{c}' AS col, {c} AS v FROM tr" for p, c in enumerate(RULE_COLS))
    qs = "[" + ", ".join(repr(float(q)) for q in quantiles) + "]"
    return f"""
tr AS (SELECT row_number() OVER () AS rid, * FROM traces),
tv AS ({tv}),
qs AS (SELECT pos, col, list_sort(list_distinct(list_append(quantile_disc(v, {qs}), max(v) + 1))) AS th
       FROM tv GROUP BY pos, col),
thr AS (SELECT pos, col, unnest(th) AS t, generate_subscripts(th, 1) - 1 AS i, len(th) AS nth FROM qs),
iv AS (SELECT quantile_disc({TARGET}, 0.5) AS fr, max({TARGET}) AS tt FROM traces),
lab AS (SELECT tr.rid, {TARGET} AS y, ({TARGET} > iv.fr AND {TARGET} <= iv.tt) AS pos FROM tr, iv),
conds AS (
  SELECT a.pos AS c, a.col, a.i AS lo, b.i AS hi, a.t AS t_lo, b.t AS t_hi,
         NOT (a.i = 0 AND b.i = a.nth - 1) AS feasible
  FROM thr a JOIN thr b ON a.pos = b.pos AND a.i < b.i)"""


def rules_ctes(cond_filter: str = "TRUE", depth: int = 2, empty: bool = True) -> str:
    """``rule_conds(rule_id, nc, c, t_lo, t_hi)`` and ``rules(rule_id, nc)`` up to ``depth``."""
    parts = []
    if empty:
        parts.append("SELECT '' AS rule_id, 0 AS nc, NULL::INT AS c, NULL::DOUBLE AS t_lo, NULL::DOUBLE AS t_hi")
    parts.append(f"""SELECT c::VARCHAR || ':' || lo::VARCHAR || ':' || hi::VARCHAR, 1, c, t_lo, t_hi
                     FROM cc""")
    if depth >= 2:
        key = "x.c::VARCHAR || ':' || x.lo::VARCHAR || ':' || x.hi::VARCHAR || ';' || " \
              "y.c::VARCHAR || ':' || y.lo::VARCHAR || ':' || y.hi::VARCHAR"
        for side in ("x", "y"):
            parts.append(f"SELECT {key}, 2, {side}.c, {side}.t_lo, {side}.t_hi FROM cc x JOIN cc y ON x.c < y.c")
    return f"""
cc AS (SELECT * FROM conds WHERE {cond_filter}),
rule_conds AS ({' UNION ALL '.join(parts)}),
rules AS (SELECT DISTINCT rule_id, nc FROM rule_conds)"""


MATCH_CTES = """
hits AS (
  SELECT rc.rule_id, tv.rid FROM rule_conds rc JOIN tv ON tv.pos = rc.c AND tv.v >= rc.t_lo AND tv.v < rc.t_hi
  GROUP BY rc.rule_id, tv.rid HAVING count(*) = any_value(rc.nc)
  UNION ALL
  SELECT r.rule_id, lab.rid FROM rules r, lab WHERE r.nc = 0),
scored AS (
  SELECT r.rule_id, r.nc AS n_conds,
         count(l.rid) FILTER (WHERE l.pos) AS tp, count(l.rid) FILTER (WHERE NOT l.pos) AS fp,
         count(l.rid) AS support
  FROM rules r LEFT JOIN hits h ON h.rule_id = r.rule_id LEFT JOIN lab l ON l.rid = h.rid
  GROUP BY r.rule_id, r.nc),
pcount AS (SELECT count(*) FILTER (WHERE pos) AS P FROM lab),
metrics AS (
  SELECT s.*, CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0.0 END AS precision,
         tp::DOUBLE / P AS recall
  FROM scored s, pcount),
fm AS (
  SELECT *, CASE WHEN precision > 0 OR recall > 0
                 THEN 2.0 * (precision * recall) / (precision + recall) ELSE 0.0 END AS fmeasure
  FROM metrics)"""

# the same counts for many rules: traces of equal bins of all columns are counted together
CELL_MATCH_CTES = """
binned AS (SELECT tv.rid, tv.pos, max(thr.t) AS v FROM tv JOIN thr ON thr.pos = tv.pos AND thr.t <= tv.v
           GROUP BY tv.rid, tv.pos),
trace_cell AS (SELECT rid, string_agg(pos::VARCHAR || '=' || v::VARCHAR, ';' ORDER BY pos) AS cell
               FROM binned GROUP BY rid),
cell_size AS (SELECT t.cell, count(*) FILTER (WHERE l.pos) AS np, count(*) FILTER (WHERE NOT l.pos) AS nn,
                     any_value(t.rid) AS rid FROM trace_cell t JOIN lab l ON l.rid = t.rid GROUP BY t.cell),
cell_bin AS (SELECT c.cell, b.pos, b.v FROM cell_size c JOIN binned b ON b.rid = c.rid),
cell_hits AS (
  SELECT rc.rule_id, b.cell FROM rule_conds rc JOIN cell_bin b ON b.pos = rc.c AND b.v >= rc.t_lo AND b.v < rc.t_hi
  GROUP BY rc.rule_id, b.cell HAVING count(*) = any_value(rc.nc)
  UNION ALL SELECT r.rule_id, c.cell FROM rules r, cell_size c WHERE r.nc = 0),
scored AS (
  SELECT r.rule_id, r.nc AS n_conds, coalesce(sum(c.np), 0)::BIGINT AS tp, coalesce(sum(c.nn), 0)::BIGINT AS fp,
         coalesce(sum(c.np + c.nn), 0)::BIGINT AS support
  FROM rules r LEFT JOIN cell_hits h ON h.rule_id = r.rule_id LEFT JOIN cell_size c ON c.cell = h.cell
  GROUP BY r.rule_id, r.nc),
pcount AS (SELECT count(*) FILTER (WHERE pos) AS P FROM lab),
metrics AS (
  SELECT s.*, CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0.0 END AS precision,
         tp::DOUBLE / P AS recall
  FROM scored s, pcount),
fm AS (
  SELECT *, CASE WHEN precision > 0 OR recall > 0
                 THEN 2.0 * (precision * recall) / (precision + recall) ELSE 0.0 END AS fmeasure
  FROM metrics)"""

SCORED_SELECT = """SELECT rule_id, n_conds, tp, fp, support, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(fmeasure, 6) AS fmeasure FROM fm"""


def scoring_sql() -> dict[str, str]:
    head = base_ctes() + "," + space_ctes()
    rhead = head.replace("WITH ", "WITH RECURSIVE ", 1)
    bucket_b = """
bk AS (SELECT tv.rid, tv.pos, count(thr.t) FILTER (WHERE thr.t <= tv.v) AS b
       FROM tv JOIN thr ON thr.pos = tv.pos GROUP BY tv.rid, tv.pos),
cells AS (SELECT rid, string_agg(b::VARCHAR, ',' ORDER BY pos) AS b FROM bk GROUP BY rid)"""
    return {
        "quantile_thresholds": f"{head} SELECT col, pos::INT AS pos, i::INT AS i, t AS threshold FROM thr",
        "label_counts": f"""{head} SELECT count(*) FILTER (WHERE pos) AS positives,
            count(*) FILTER (WHERE NOT pos) AS negatives FROM lab""",
        "threshold_counts": f"""{head} SELECT thr.col, thr.i::INT AS i, thr.t AS threshold,
            count(*) FILTER (WHERE lab.pos AND tv.v >= thr.t) AS positives,
            count(*) FILTER (WHERE NOT lab.pos AND tv.v >= thr.t) AS negatives
            FROM thr JOIN tv ON tv.pos = thr.pos JOIN lab ON lab.rid = tv.rid
            GROUP BY thr.col, thr.i, thr.t""",
        "bucket_cube": f"""{head}, {bucket_b}
            SELECT c.b, ((l.y > iv.fr)::INT + (l.y > iv.tt)::INT) AS yb, count(*) AS n,
                   sum(l.y - iv.fr) AS s1, sum((l.y - iv.fr) * (l.y - iv.fr)) AS s2
            FROM cells c JOIN lab l ON l.rid = c.rid, iv GROUP BY c.b, yb""",
        "condition_space": f"{head} SELECT c::INT AS c, col, lo::INT AS lo, hi::INT AS hi, t_lo, t_hi, feasible FROM conds",
        "rule_decode": f"""{rhead}, {subset_ctes("TRUE")}
            SELECT rc.rule_id, cc.col, rc.t_lo, rc.t_hi FROM rule_conds rc
            JOIN (SELECT DISTINCT c, col FROM conds) cc ON cc.c = rc.c WHERE rc.nc > 0""",
        "rule_metrics": f"{rhead}, {subset_ctes('TRUE')}, {CELL_MATCH_CTES} {SCORED_SELECT}",
        "wide_rule_metrics": f"{with_(wide_ctes())}, {rules_ctes('hi = lo + 1')}, {MATCH_CTES} {SCORED_SELECT}",
        "bin_features": f"{head} SELECT c::INT AS c, col, lo::INT AS lo, hi::INT AS hi, t_lo, t_hi FROM conds WHERE hi = lo + 1",
        "bin_features_scored": f"{head}, {rules_ctes('hi = lo + 1', depth=1)}, {MATCH_CTES} {SCORED_SELECT}",
    }


# ------------------------------------------------------------------ rule sets, Pareto

SET_CTES = """
feat AS (SELECT c, lo, hi, t_lo, t_hi, c::VARCHAR || ':' || lo::VARCHAR || ':' || hi::VARCHAR AS fk
         FROM conds WHERE {which}),
fpair AS (SELECT f.fk AS f_fk, g.fk AS g_fk, f.c AS fc, f.t_lo AS flo, f.t_hi AS fhi,
                 g.c AS gc, g.t_lo AS glo, g.t_hi AS ghi
          FROM feat f JOIN feat g ON (f.c, f.lo, f.hi) < (g.c, g.lo, g.hi)),
set_conds AS (
  SELECT fk AS set_id, 0 AS r, 1 AS nc, c, t_lo, t_hi FROM feat
  UNION ALL SELECT f_fk || '|' || g_fk, 0, 1, fc, flo, fhi FROM fpair
  UNION ALL SELECT f_fk || '|' || g_fk, 1, 1, gc, glo, ghi FROM fpair),
set_rules AS (SELECT DISTINCT set_id, r FROM set_conds),
srh AS (
  SELECT s.set_id, s.r, tv.rid FROM set_conds s
  JOIN tv ON tv.pos = s.c AND tv.v >= s.t_lo AND tv.v < s.t_hi
  GROUP BY s.set_id, s.r, tv.rid HAVING count(*) = any_value(s.nc)),
per_trace AS (SELECT set_id, rid, count(*) AS m FROM srh GROUP BY set_id, rid),
setlist AS (SELECT set_id, count(*) AS n_rules FROM set_rules GROUP BY set_id),
setagg AS (
  SELECT s.set_id, s.n_rules,
         count(l.rid) FILTER (WHERE l.pos) AS tp, count(l.rid) FILTER (WHERE NOT l.pos) AS fp,
         count(l.rid) FILTER (WHERE pt.m = 1) AS uniq, coalesce(sum(pt.m), 0) AS tot
  FROM setlist s LEFT JOIN per_trace pt ON pt.set_id = s.set_id LEFT JOIN lab l ON l.rid = pt.rid
  GROUP BY s.set_id, s.n_rules),
ruleagg AS (
  SELECT sr.set_id, sr.r, count(l.rid) AS n_r, count(l.rid) FILTER (WHERE l.pos) AS tp_r,
         sum(l.y) AS s1_r, sum(l.y * l.y) AS s2_r
  FROM set_rules sr LEFT JOIN srh h ON h.set_id = sr.set_id AND h.r = sr.r
  LEFT JOIN lab l ON l.rid = h.rid GROUP BY sr.set_id, sr.r),
pcount AS (SELECT count(*) FILTER (WHERE pos) AS P FROM lab),
rulestat AS (
  SELECT set_id, sum(CASE WHEN n_r > 0 THEN s2_r - (s1_r * s1_r) / n_r ELSE 0.0 END) AS dissimilarity,
         min(tp_r / P) AS min_rule_recall
  FROM ruleagg, pcount GROUP BY set_id),
sm AS (
  SELECT a.set_id, a.n_rules, a.tp, a.fp, tp::DOUBLE / P AS recall,
         CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS precision,
         CASE WHEN tot > 0 THEN uniq::DOUBLE / tot ELSE 0.0 END AS disjointness,
         rs.dissimilarity, rs.min_rule_recall > 0.05 AS feasible
  FROM setagg a JOIN rulestat rs USING (set_id), pcount),
sm2 AS (
  SELECT *, CASE WHEN precision > 0 OR recall > 0
                 THEN 2.0 * (precision * recall) / (precision + recall) ELSE 0.0 END AS fscore,
         CASE WHEN precision * recall + precision * disjointness + recall * disjointness <> 0
              THEN (3.0 * precision * recall * disjointness)
                   / (precision * recall + precision * disjointness + recall * disjointness)
              ELSE 0.0 END AS harmonic,
         CASE WHEN feasible THEN precision ELSE 0.0 END AS fit_p,
         CASE WHEN feasible THEN recall ELSE 0.0 END AS fit_r,
         CASE WHEN feasible THEN dissimilarity ELSE 'inf'::DOUBLE END AS fit_d
  FROM sm),
pts AS (SELECT fit_p, fit_r, fit_d, min(set_id) AS set_id FROM sm2 GROUP BY fit_p, fit_r, fit_d),
front AS (
  SELECT s.* FROM sm2 s JOIN pts a USING (set_id)
  WHERE NOT EXISTS (
    SELECT 1 FROM pts b WHERE b.fit_p >= a.fit_p AND b.fit_r >= a.fit_r AND b.fit_d <= a.fit_d
      AND (b.fit_p > a.fit_p OR b.fit_r > a.fit_r OR b.fit_d < a.fit_d)))"""


def _crowd_term(expr: str, i: int) -> str:
    return f"""CASE WHEN lag({expr}) OVER w{i} IS NULL OR lead({expr}) OVER w{i} IS NULL THEN 'inf'::DOUBLE
        WHEN 3.0 * (max({expr}) OVER () - min({expr}) OVER ()) = 0 THEN 0.0
        ELSE (lead({expr}) OVER w{i} - lag({expr}) OVER w{i})
             / (3.0 * (max({expr}) OVER () - min({expr}) OVER ())) END"""


FRONT_QUANTILES = (0.0, 0.2, 0.4, 0.6, 0.8)

# all sets of the bin features as bit masks, over traces counted by the mask of the features they match
SUBSET_FRONT_CTES = """
fl AS (SELECT f.*, row_number() OVER (ORDER BY c, lo, hi) - 1 AS bit FROM (
         SELECT c, lo, hi, t_lo, t_hi, c::VARCHAR || ':' || lo::VARCHAR || ':' || hi::VARCHAR AS fk FROM conds WHERE hi = lo + 1) f),
fh AS (SELECT fl.bit, l.rid, l.pos, l.y FROM fl JOIN tv ON tv.pos = fl.c AND tv.v >= fl.t_lo AND tv.v < fl.t_hi JOIN lab l ON l.rid = tv.rid),
pcount AS (SELECT count(*) FILTER (WHERE pos) AS P FROM lab),
fs AS (SELECT bit, count(*) FILTER (WHERE pos) AS tp, sum(y * y) - sum(y) * sum(y) / count(*) AS dev FROM fh GROUP BY bit),
ok AS (SELECT fs.*, fl.fk, row_number() OVER (ORDER BY fl.c, fl.lo, fl.hi) - 1 AS nr FROM fs JOIN fl USING (bit), pcount WHERE fs.tp / P > 0.05),
mask AS (SELECT rid, any_value(fh.pos) AS pos, sum(1::BIGINT << ok.nr) AS m FROM fh JOIN ok USING (bit) GROUP BY rid),
cell AS (SELECT m::BIGINT AS m, count(*) FILTER (WHERE pos) AS np, count(*) FILTER (WHERE NOT pos) AS nn FROM mask GROUP BY m),
sets AS (SELECT range AS s FROM range(1, (SELECT 1::BIGINT << count(*) FROM ok))),
cover AS (SELECT s, sum(np)::BIGINT AS tp, sum(nn)::BIGINT AS fp FROM sets JOIN cell ON (sets.s & cell.m) <> 0 GROUP BY s),
parts AS (SELECT s, sum(dev) AS d, string_agg(fk, '|' ORDER BY nr) AS set_id, count(*) AS n_rules
          FROM sets JOIN ok ON (sets.s >> ok.nr) & 1 = 1 GROUP BY s),
pts AS (SELECT c.tp, c.fp, p.d, p.set_id, p.n_rules FROM cover c JOIN parts p USING (s)
        QUALIFY row_number() OVER (PARTITION BY c.tp, c.fp ORDER BY round(p.d, 4), p.set_id) = 1),
best AS (SELECT *, tp::DOUBLE / (tp + fp) AS prec FROM pts),
front AS (SELECT a.* FROM best a WHERE NOT EXISTS (
            SELECT 1 FROM best b WHERE b.tp >= a.tp AND b.prec >= a.prec AND b.d <= a.d AND (b.tp > a.tp OR b.prec > a.prec OR b.d < a.d)))"""


def ruleset_sql() -> dict[str, str]:
    plain = base_ctes() + "," + space_ctes()
    head = plain + "," + SET_CTES.format(which="hi = lo + 1")
    fhead = base_ctes() + "," + space_ctes(FRONT_QUANTILES) + "," + SET_CTES.format(which="TRUE")
    r6 = lambda c: f"round({c}, 6) AS {c}"
    metrics = ", ".join(r6(c) for c in ("precision", "recall", "disjointness", "dissimilarity", "fscore",
                                        "harmonic", "fit_p", "fit_r", "fit_d"))
    objs = ["fit_p", "fit_r", "-fit_d"]
    crowd = " + ".join(f"({_crowd_term(o, i)})" for i, o in enumerate(objs))
    windows = ", ".join(f"w{i} AS (ORDER BY {o} ASC, set_id ASC)" for i, o in enumerate(objs))
    return {
        "ruleset_metrics": f"SELECT set_id, n_rules, tp, fp, {metrics}, feasible FROM sm2".join(
            [head + " ", ""]),
        "ruleset_sizes": f"{head} SELECT set_id, r::INT AS r, n_r AS size FROM ruleagg",
        "ruleset_front": f"""{plain}, {SUBSET_FRONT_CTES}
            SELECT set_id, n_rules::INT AS n_rules, tp, fp, round(prec, 6) AS fit_p, round(tp::DOUBLE / pcount.P, 6) AS fit_r, round(d, 2) AS fit_d
            FROM front, pcount""",
        "pareto_front": f"{fhead} SELECT set_id, {r6('fit_p')}, {r6('fit_r')}, {r6('fit_d')} FROM front",
        "pareto_crowding": f"""{fhead}, cr AS (SELECT set_id, fit_p, fit_r, fit_d, {crowd} AS crowding
            FROM front WINDOW {windows})
            SELECT set_id, {r6('fit_p')}, {r6('fit_r')}, {r6('fit_d')}, {r6('crowding')} FROM cr""",
        "beta_best": f"""{fhead},
            betas AS (SELECT i::DOUBLE / 100.0::DOUBLE AS beta FROM range(10, 101) t(i)),
            fb AS (SELECT f.set_id, f.precision, f.recall, f.dissimilarity, b.beta,
                     CASE WHEN (b.beta * b.beta) * f.precision + f.recall <> 0
                          THEN (1.0 + b.beta * b.beta) * ((f.precision * f.recall)
                               / ((b.beta * b.beta) * f.precision + f.recall)) ELSE 0.0 END AS fbeta
                   FROM front f, betas b),
            win AS (SELECT * FROM fb QUALIFY row_number() OVER (
                      PARTITION BY beta ORDER BY fbeta DESC, dissimilarity ASC, set_id ASC) = 1)
            SELECT set_id, {r6('precision')}, {r6('recall')}, {r6('dissimilarity')}, {r6('beta')}
            FROM win ORDER BY dissimilarity ASC, beta ASC LIMIT 1""",
    }


# ------------------------------------------------------------------ searches, segmentation

SEG_QUANTILES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)


def _key(a: str) -> str:
    return f"{a}.c::VARCHAR || ':' || {a}.lo::VARCHAR || ':' || {a}.hi::VARCHAR"


def subset_ctes(which: str) -> str:
    """Rules of any number of the conditions that ``which`` selects, one per column."""
    return f"""
feat AS (SELECT c, lo, hi, t_lo, t_hi, {_key('conds')} AS fk FROM conds WHERE {which}),
subsets(rule_id, last_c, nc) AS (
  SELECT '', -1, 0
  UNION ALL
  SELECT CASE WHEN s.nc = 0 THEN f.fk ELSE s.rule_id || ';' || f.fk END, f.c, s.nc + 1
  FROM subsets s JOIN feat f ON f.c > s.last_c),
rules AS (SELECT rule_id, nc FROM subsets),
rule_conds AS (
  SELECT r.rule_id, r.nc, f.c, f.t_lo, f.t_hi
  FROM (SELECT rule_id, nc, unnest(string_split(rule_id, ';')) AS part FROM rules WHERE nc > 0) r
  JOIN feat f ON f.fk = r.part
  UNION ALL SELECT rule_id, 0, NULL, NULL, NULL FROM rules WHERE nc = 0)"""


SUBSET_CTES = subset_ctes("hi = lo + 1")
USABLE = "feasible AND c IN (SELECT pos FROM qs WHERE len(th) >= 3)"

BEST_SELECT = """SELECT rule_id, n_conds, tp, fp, support, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(fmeasure, 6) AS fmeasure FROM fm
  ORDER BY fmeasure DESC, n_conds ASC, rule_id ASC LIMIT 1"""


SEG_HIT_CTES = """allhits AS (
  SELECT rc.rule_id, tv.rid FROM rule_conds rc JOIN tv ON tv.pos = rc.c AND tv.v >= rc.t_lo AND tv.v < rc.t_hi
  GROUP BY rc.rule_id, tv.rid HAVING count(*) = any_value(rc.nc)
  UNION ALL SELECT r.rule_id, lab.rid FROM rules r, lab WHERE r.nc = 0),
rsup AS (SELECT r.rule_id, r.nc, count(h.rid) AS support FROM rules r LEFT JOIN allhits h USING (rule_id)
         GROUP BY r.rule_id, r.nc),
rtp AS (SELECT h.rule_id, iv.j, iv.i, count(*) AS tp FROM allhits h JOIN lab l ON l.rid = h.rid
        JOIN seg_iv iv ON l.y > iv.s_from AND l.y <= iv.s_to GROUP BY h.rule_id, iv.j, iv.i),"""

SEG_CELL_CTES = """binned AS (SELECT tv.rid, tv.pos, max(thr.t) AS v FROM tv JOIN thr ON thr.pos = tv.pos AND thr.t <= tv.v
           GROUP BY tv.rid, tv.pos),
trace_cell AS (SELECT rid, string_agg(pos::VARCHAR || '=' || v::VARCHAR, ';' ORDER BY pos) AS cell FROM binned GROUP BY rid),
cell_one AS (SELECT cell, any_value(rid) AS rid, count(*) AS n FROM trace_cell GROUP BY cell),
cell_bin AS (SELECT c.cell, b.pos, b.v FROM cell_one c JOIN binned b ON b.rid = c.rid),
cell_iv AS (SELECT t.cell, iv.j, iv.i, count(*) AS n FROM trace_cell t JOIN lab l ON l.rid = t.rid
            JOIN seg_iv iv ON l.y > iv.s_from AND l.y <= iv.s_to GROUP BY t.cell, iv.j, iv.i),
cell_hits AS (
  SELECT rc.rule_id, b.cell FROM rule_conds rc JOIN cell_bin b ON b.pos = rc.c AND b.v >= rc.t_lo AND b.v < rc.t_hi
  GROUP BY rc.rule_id, b.cell HAVING count(*) = any_value(rc.nc)
  UNION ALL SELECT r.rule_id, c.cell FROM rules r, cell_one c WHERE r.nc = 0),
rsup AS (SELECT r.rule_id, r.nc, coalesce(sum(c.n), 0)::BIGINT AS support FROM rules r LEFT JOIN cell_hits h USING (rule_id)
         LEFT JOIN cell_one c ON c.cell = h.cell GROUP BY r.rule_id, r.nc),
rtp AS (SELECT h.rule_id, v.j, v.i, sum(v.n)::BIGINT AS tp FROM cell_hits h JOIN cell_iv v USING (cell) GROUP BY h.rule_id, v.j, v.i),"""


def _seg_ctes(cells: bool = False) -> str:
    """Best rule per interval, by the traces that each rule matches, or (``cells``, for many rules) by those of equal
    bins of all columns counted together."""
    hits = SEG_CELL_CTES if cells else SEG_HIT_CTES
    qs = "[" + ", ".join(repr(float(q)) for q in SEG_QUANTILES) + "]"
    return f"""
spts AS (SELECT list_sort(list_distinct(quantile_disc({TARGET}, {qs}))) AS pts FROM traces),
seg_iv AS (SELECT a.j::INT AS j, b.i::INT AS i, pts[a.j + 1] AS s_from, pts[b.i + 1] AS s_to
           FROM spts, range(0, len(pts)) a(j), range(0, len(pts)) b(i) WHERE a.j < b.i),
{hits}
ivp AS (SELECT iv.j, iv.i, count(l.rid) AS P FROM seg_iv iv LEFT JOIN lab l ON l.y > iv.s_from AND l.y <= iv.s_to
        GROUP BY iv.j, iv.i),
segm AS (
  SELECT s.rule_id, s.nc AS n_conds, iv.j, iv.i, iv.s_from, iv.s_to, coalesce(t.tp, 0) AS tp,
         s.support - coalesce(t.tp, 0) AS fp, s.support, p.P,
         CASE WHEN s.support > 0 THEN coalesce(t.tp, 0)::DOUBLE / s.support ELSE 0.0 END AS precision,
         coalesce(t.tp, 0)::DOUBLE / p.P AS recall
  FROM rsup s CROSS JOIN seg_iv iv JOIN ivp p ON p.j = iv.j AND p.i = iv.i
  LEFT JOIN rtp t ON t.rule_id = s.rule_id AND t.j = iv.j AND t.i = iv.i),
segf AS (
  SELECT *, CASE WHEN precision > 0 OR recall > 0
                 THEN 2.0 * (precision * recall) / (precision + recall) ELSE 0.0 END AS fmeasure
  FROM segm),
segbest AS (SELECT * FROM segf QUALIFY row_number() OVER (
              PARTITION BY j, i ORDER BY fmeasure DESC, n_conds ASC, rule_id ASC) = 1),
paths(last_i, total, starts) AS (
  SELECT 0, 0.0::DOUBLE, []::INT[]
  UNION ALL
  SELECT b.i, p.total + b.fmeasure, list_append(p.starts, b.j)
  FROM paths p JOIN segbest b ON b.j = p.last_i),
bestpath AS (
  SELECT total, starts FROM paths, spts WHERE last_i = len(pts) - 1
  ORDER BY total DESC, list_reverse(starts) ASC LIMIT 1)"""


def search_sql() -> dict[str, str]:
    head = base_ctes() + "," + space_ctes()
    rhead = head.replace("WITH ", "WITH RECURSIVE ", 1)
    seeds = f"""
nth AS (SELECT pos AS c, len(th) AS nth FROM qs),
seeds AS (SELECT c, lo, hi, {_key('conds')} AS fk FROM conds WHERE hi = lo + 1),
uc AS (SELECT conds.c, lo, hi, {_key('conds')} AS fk FROM conds JOIN nth USING (c) WHERE feasible AND nth >= 3),
nb AS (
  SELECT s.fk AS parent_id, 'add' AS move,
         CASE WHEN s.c < u.c THEN s.fk || ';' || u.fk ELSE u.fk || ';' || s.fk END AS rule_id
  FROM seeds s JOIN uc u ON u.c <> s.c
  UNION ALL SELECT fk, 'remove', '' FROM seeds
  UNION ALL
  SELECT s.fk, 'modify', s.c::VARCHAR || ':' || least(e.a, e.b)::VARCHAR || ':' || greatest(e.a, e.b)::VARCHAR
  FROM seeds s JOIN nth USING (c), range(0, nth.nth) v(x),
       LATERAL (SELECT v.x AS a, s.hi AS b UNION ALL SELECT s.lo, v.x) e
  WHERE e.a <> e.b AND NOT (least(e.a, e.b) = s.lo AND greatest(e.a, e.b) = s.hi))"""
    return {
        "bnb_best_rule": f"{rhead}, {SUBSET_CTES}, {MATCH_CTES} {BEST_SELECT}",
        "best_rule": f"{rhead}, {subset_ctes(USABLE)}, {CELL_MATCH_CTES} {BEST_SELECT}",
        # the beam search must end at the rule that the exhaustive one finds
        "beam_rule": f"""{rhead}, {subset_ctes(USABLE)}, {CELL_MATCH_CTES},
            best AS ({BEST_SELECT}),
            parts AS (SELECT best.rule_id, string_split(best.rule_id, ';') AS ps FROM best),
            words AS (SELECT p.rule_id, string_agg(f.col || ' in [' || f.t_lo::VARCHAR || ', ' || f.t_hi::VARCHAR || ')',
                                                   ' AND ' ORDER BY f.c) AS rule_text
                      FROM parts p, (SELECT conds.*, {_key('conds')} AS fk FROM conds) f
                      WHERE list_contains(p.ps, f.fk) GROUP BY p.rule_id)
            SELECT best.*, coalesce(words.rule_text, '') AS rule_text
            FROM best LEFT JOIN words USING (rule_id)""",
        "rule_neighbours": f"""{head}, {seeds}
            SELECT DISTINCT parent_id, move, rule_id FROM nb WHERE rule_id NOT IN (SELECT fk FROM seeds)""",
        "segment_intervals": f"{rhead}, {SUBSET_CTES}, {_seg_ctes()} SELECT j, i, s_from, s_to FROM seg_iv",
        "segment_scores": f"""{rhead}, {SUBSET_CTES}, {_seg_ctes()}
            SELECT j, i, s_from, s_to, rule_id, n_conds, tp, fp, P, round(precision, 6) AS precision,
                   round(recall, 6) AS recall, round(fmeasure, 6) AS fmeasure FROM segbest""",
        "segment_best_rules": f"""{rhead}, {subset_ctes(USABLE)}, {_seg_ctes(cells=True)}
            SELECT j, i, s_from, s_to, rule_id, n_conds, tp, fp, P, round(precision, 6) AS precision,
                   round(recall, 6) AS recall, round(fmeasure, 6) AS fmeasure FROM segbest""",
        "segmentation": f"""{rhead}, {SUBSET_CTES}, {_seg_ctes()},
            chosen AS (SELECT bp.total, g.seg::INT - 1 AS seg, g.j
                       FROM bestpath bp, LATERAL (SELECT unnest(bp.starts) AS j,
                                                         generate_subscripts(bp.starts, 1) AS seg) g),
            ends AS (SELECT c.*, coalesce(lead(c.j) OVER (ORDER BY c.seg), (SELECT len(pts) - 1 FROM spts)) AS i
                     FROM chosen c)
            SELECT e.seg, e.j, e.i::INT AS i, b.s_from, b.s_to, b.rule_id, round(b.fmeasure, 6) AS fmeasure,
                   round(e.total, 6) AS total
            FROM ends e JOIN segbest b ON b.j = e.j AND b.i = e.i""",
    }


# ------------------------------------------------------------------ mean-shift thresholds

# seeds moved one by one, over all points; modes taken one by one, strongest first
MODE_CTES = """
bw AS (SELECT k.col, n.n, sum(k.wa * k.dk) / n.n AS bandwidth, min(k.v) AS vmin, max(k.v) AS vmax
       FROM kth k JOIN ncol n USING (col) GROUP BY k.col, n.n),
points AS (SELECT col, list({'v': v, 'w': w} ORDER BY v) AS pts FROM hist GROUP BY col),
bins AS (SELECT h.col, round_even(h.v / b.bandwidth, 0) AS bin, b.bandwidth, b.n
         FROM hist h JOIN bw b USING (col) WHERE b.bandwidth > 0 GROUP BY ALL),
nbins AS (SELECT col, count(*) AS nb FROM bins GROUP BY col),
seeds AS (
  SELECT bins.col, bin * bandwidth AS mean, bandwidth FROM bins JOIN nbins USING (col) WHERE nb <> n
  UNION ALL
  SELECT h.col, h.v, b.bandwidth FROM hist h JOIN bw b USING (col) JOIN nbins c USING (col) WHERE c.nb = b.n),
moved(col, seed, mean, bandwidth, intensity, done) AS (
  SELECT col, mean, mean, bandwidth, 0::DOUBLE, FALSE FROM seeds
  UNION ALL
  SELECT col, seed, new, bandwidth, sw, abs(new - mean) < 1e-3::DOUBLE * bandwidth
  FROM (SELECT *, svw / sw AS new FROM (
          SELECT m.col, m.seed, m.mean, m.bandwidth,
                 list_sum(list_transform(list_filter(p.pts, lambda x: abs(x.v - m.mean) <= m.bandwidth), lambda x: x.v * x.w)) AS svw,
                 list_sum(list_transform(list_filter(p.pts, lambda x: abs(x.v - m.mean) <= m.bandwidth), lambda x: x.w))::DOUBLE AS sw
          FROM moved m JOIN points p USING (col) WHERE NOT m.done) WHERE sw > 0)),
found AS (SELECT col, mean, any_value(bandwidth) AS bandwidth, max(intensity) AS intensity FROM moved WHERE done GROUP BY col, mean),
ranked AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY intensity DESC, mean) - 1 AS rank FROM found),
taken(col, rank, kept) AS (
  SELECT DISTINCT col, -1::BIGINT, []::DOUBLE[] FROM ranked
  UNION ALL
  SELECT t.col, r.rank, CASE WHEN len(list_filter(t.kept, lambda x: abs(x - r.mean) <= r.bandwidth)) = 0
                             THEN list_append(t.kept, r.mean) ELSE t.kept END
  FROM taken t JOIN ranked r ON r.col = t.col AND r.rank = t.rank + 1),
centres AS (SELECT col, kept FROM taken QUALIFY row_number() OVER (PARTITION BY col ORDER BY rank DESC) = 1)"""


def meanshift_sql() -> dict[str, str]:
    head = base_ctes() + "," + space_ctes()
    rhead = head.replace("WITH ", "WITH RECURSIVE ", 1)
    hist = """
hist AS (SELECT col, v, count(*) AS w FROM tv WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY col, v),
ncol AS (SELECT col, sum(w) AS n, greatest(1, floor(sum(w) * 0.1::DOUBLE))::BIGINT AS k FROM hist GROUP BY col),
pairs AS (SELECT a.col, a.v, a.w AS wa, abs(b.v - a.v) AS d, b.w AS wb FROM hist a JOIN hist b ON a.col = b.col),
cum AS (SELECT col, v, wa, d, sum(wb) OVER (PARTITION BY col, v ORDER BY d ROWS UNBOUNDED PRECEDING) AS cw
        FROM pairs),
kth AS (SELECT c.col, c.v, any_value(c.wa) AS wa, min(c.d) AS dk FROM cum c JOIN ncol USING (col)
        WHERE c.cw >= ncol.k GROUP BY c.col, c.v)"""
    return {
        "value_histogram": f"{head}, {hist} SELECT col, v, w FROM hist",
        "bandwidth": f"""{head}, {hist}
            SELECT k.col, n.n, n.k, sum(k.wa * k.dk) / n.n AS bandwidth
            FROM kth k JOIN ncol n USING (col) GROUP BY k.col, n.n, n.k""",
        "meanshift_modes": f"""{rhead}, {hist}, {MODE_CTES}
            SELECT m.col, m.mean, m.intensity::BIGINT AS intensity, list_contains(k.kept, m.mean) AS kept, m.rank
            FROM ranked m JOIN centres k USING (col)""",
        "meanshift_thresholds": f"""{rhead}, {hist}, {MODE_CTES},
            near AS (SELECT h.col, h.v, m.mean AS label FROM hist h JOIN ranked m USING (col) JOIN centres k USING (col)
                     WHERE list_contains(k.kept, m.mean)
                     QUALIFY row_number() OVER (PARTITION BY h.col, h.v ORDER BY abs(h.v - m.mean), m.rank) = 1),
            firsts AS (SELECT col, min(v) AS t FROM near GROUP BY col, label),
            cuts AS (SELECT b.col, CASE WHEN b.vmin = b.vmax THEN [b.vmin, b.vmin + 1]
                                        WHEN b.bandwidth <= 0 OR count(f.t) = 0 THEN [b.vmin, b.vmax + 1]
                                        ELSE list_sort(list_distinct(list_append(list(f.t), b.vmax + 1))) END AS th
                     FROM bw b LEFT JOIN firsts f USING (col) GROUP BY b.col, b.vmin, b.vmax, b.bandwidth)
            SELECT col, (row_number() OVER (ORDER BY col) - 1)::INT AS pos, unnest(range(len(th)))::INT AS i, unnest(th) AS threshold
            FROM cuts""",
    }


# ------------------------------------------------------------------ rule-set neighbourhood

RULES = "STRUCT(c BIGINT, lo BIGINT, hi BIGINT)[][]"
NAMED = ("array_to_string(list_transform(rules, lambda r: array_to_string(list_transform(r, "
         "lambda x: x.c::VARCHAR || ':' || x.lo::VARCHAR || ':' || x.hi::VARCHAR), ';')), '|')")
SEED_CTES = f"""
nth AS (SELECT pos::BIGINT AS c, len(th) AS nth FROM qs),
u AS (SELECT {{'c': c::BIGINT, 'lo': lo::BIGINT, 'hi': hi::BIGINT}} AS x FROM conds),
b AS (SELECT x FROM u WHERE x.hi = x.lo + 1),
sets AS (
  SELECT [[x]]::{RULES} AS rules FROM u
  UNION ALL SELECT [[f.x], [g.x]] FROM b f JOIN b g ON f.x.c = 0 AND g.x.c = 1
  UNION ALL SELECT [[f.x, g.x]] FROM b f JOIN b g ON f.x.c = 0 AND g.x.c = 1),
seeds AS (SELECT {NAMED} AS parent_id, rules FROM sets)"""


def _canonical(inner: str) -> str:
    """Sets of ``inner`` (with columns ``rules`` and others) with the rules sorted inside, and the set sorted."""
    return f"(SELECT * REPLACE (list_sort(list_transform(rules, lambda r: list_sort(r))) AS rules) FROM ({inner}))"


def ruleset_neighbour_sql() -> dict[str, str]:
    """Every move on every set, by list functions."""
    head = base_ctes() + "," + space_ctes()
    rhead = head.replace("WITH ", "WITH RECURSIVE ", 1)
    rest = "list_filter(rules, lambda r, i: i <> k)"  # the set without its rule k
    moves = f"""
rule_at AS (SELECT parent_id, rules, unnest(range(1, len(rules) + 1)) AS k FROM seeds),
rl AS (SELECT *, rules[k] AS r FROM rule_at),
cond_at AS (SELECT *, unnest(range(1, len(r) + 1)) AS q FROM rl),
moved AS (
  SELECT parent_id, 'add_rule' AS move, list_append(rules, [u.x]) AS rules FROM seeds, u
  UNION ALL SELECT parent_id, 'remove_rule', {rest} FROM rl WHERE len(rules) > 1
  UNION ALL
  SELECT parent_id, 'split', list_concat({rest}, [
           list_append(list_filter(r, lambda y, i: i <> q), {{'c': r[q].c, 'lo': r[q].lo, 'hi': cut}}),
           list_append(list_filter(r, lambda y, i: i <> q), {{'c': r[q].c, 'lo': cut, 'hi': r[q].hi}})])
  FROM (SELECT *, unnest(range(r[q].lo + 1, r[q].hi)) AS cut FROM cond_at)
  UNION ALL
  SELECT parent_id, 'complement', list_concat({rest}, [
           list_append(r, {{'c': c, 'lo': 0::BIGINT, 'hi': cut}}), list_append(r, {{'c': c, 'lo': cut, 'hi': nth - 1}})])
  FROM (SELECT rl.*, nth.c, nth.nth, unnest(range(1, nth.nth - 1)) AS cut FROM rl, nth
        WHERE nth.nth > 2 AND NOT list_contains(list_transform(r, lambda y: y.c), nth.c))
  UNION ALL
  SELECT parent_id, 'add_cond', list_append({rest}, list_append(r, u.x)) FROM rl, u
  WHERE NOT list_contains(list_transform(r, lambda y: y.c), u.x.c)
  UNION ALL
  SELECT parent_id, 'remove_cond', list_append({rest}, list_filter(r, lambda y, i: i <> q)) FROM cond_at WHERE len(r) > 1)"""
    mixed = """list_filter(flatten(list_transform(range(1, greatest(len(a.rules), len(b.rules)) + 1), lambda t: [a.rules[t], b.rules[t]])),
               lambda r: r IS NOT NULL)"""
    return {
        "ruleset_neighbours": f"""{head}, {SEED_CTES}, {moves}
            SELECT DISTINCT parent_id, move, set_id FROM (SELECT parent_id, move, {NAMED} AS set_id FROM {_canonical('SELECT * FROM moved')})
            WHERE set_id NOT IN (SELECT parent_id FROM seeds)""",
        "ruleset_recombined": f"""{head}, {SEED_CTES},
            mix AS (SELECT a.parent_id, {mixed} AS m FROM seeds a JOIN seeds b ON a.parent_id <> b.parent_id),
            cuts AS (SELECT parent_id, m, unnest(range(1, len(m))) AS cut FROM mix),
            halves AS (SELECT parent_id, m[1:cut] AS rules FROM cuts UNION ALL SELECT parent_id, m[cut + 1:] FROM cuts)
            SELECT DISTINCT parent_id, {NAMED} AS set_id FROM {_canonical('SELECT * FROM halves')}""",
        # the nodes that the support test reaches, and the best of them
        "bnb_support_bound": f"""{rhead}, {SUBSET_CTES}, {MATCH_CTES},
            lastc AS (SELECT rule_id, coalesce(max(c), -1) AS last_c FROM rule_conds GROUP BY rule_id),
            node AS (SELECT fm.*, lastc.last_c, (SELECT count(*) FROM feat WHERE feat.c > lastc.last_c) AS rem,
                            CASE WHEN precision > 0 THEN P / precision ELSE 'inf'::DOUBLE END AS own
                     FROM fm JOIN lastc USING (rule_id), pcount),
            reach(rule_id, support, last_c, rem, n_conds, mu) AS (
              SELECT rule_id, support, last_c, rem, n_conds, own FROM node WHERE rule_id = ''
              UNION ALL
              SELECT c.rule_id, c.support, c.last_c, c.rem, c.n_conds, least(p.mu, c.own)
              FROM reach p JOIN feat f ON f.c > p.last_c
              JOIN node c ON c.rule_id = CASE WHEN p.n_conds = 0 THEN f.fk ELSE p.rule_id || ';' || f.fk END
              WHERE p.support - c.support >= (p.support - p.mu) / p.rem)
            SELECT b.* FROM ({SCORED_SELECT} WHERE rule_id IN (SELECT rule_id FROM reach)
                             ORDER BY fm.fmeasure DESC, n_conds, rule_id LIMIT 1) b""",
    }


# ------------------------------------------------------------------ forest

TREES, DRAWN, FOREST_SEED, LEVELS = 50, 2, 42, 24


def forest_ctes() -> str:
    """``nodes`` of the forest, every trace moved down every tree, level by level."""
    k = len(RULE_COLS)
    x = ", ".join(RULE_COLS)
    parts = [f"""
sla AS (SELECT quantile_disc({TARGET}, 0.2) AS v FROM traces),
data AS MATERIALIZED (SELECT row_number() OVER () AS rid, [{x}] AS x, ({TARGET} > sla.v)::INT AS y FROM traces, sla),
leaf AS (SELECT greatest(1, floor(sum(y) * 0.05::DOUBLE))::BIGINT AS least FROM data),
at0 AS MATERIALIZED (SELECT t.tree, 0::BIGINT AS id, d.rid, d.x, d.y FROM data d, range({TREES}) t(tree))"""]
    for d in range(LEVELS):
        parts.append(f"""
tot{d} AS MATERIALIZED (SELECT tree, id, count(*) AS n, sum(y)::BIGINT AS p FROM at{d} GROUP BY tree, id),
hist{d} AS (SELECT tree, id, f, x[f + 1] AS v, count(*) AS w, sum(y) AS a FROM at{d}, range({k}) r(f)
            WHERE x[f + 1] IS NOT NULL GROUP BY tree, id, f, v),
run{d} AS (SELECT tree, id, f, v, lead(v) OVER o AS nxt, sum(w) OVER o AS nl, sum(a) OVER o AS pl FROM hist{d}
           WINDOW o AS (PARTITION BY tree, id, f ORDER BY v)),
cand{d} AS (SELECT r.tree, r.id, r.f, v / 2 + nxt / 2 AS t, nl::DOUBLE AS nl, pl::DOUBLE AS pl, (n - nl)::DOUBLE AS nr, (p - pl)::DOUBLE AS pr
            FROM run{d} r JOIN tot{d} USING (tree, id), leaf
            WHERE nxt IS NOT NULL AND nl >= least AND n - nl >= least AND p > 0 AND p < n),
gain{d} AS (SELECT tree, id, f, t, (pl * pl + (nl - pl) * (nl - pl)) / nl + (pr * pr + (nr - pr) * (nr - pr)) / nr AS gain FROM cand{d}),
best{d} AS (SELECT * FROM gain{d} QUALIFY row_number() OVER (PARTITION BY tree, id, f ORDER BY gain DESC, t) = 1),
draw{d} AS (SELECT tree, id, f, row_number() OVER (PARTITION BY tree, id
                     ORDER BY md5('{FOREST_SEED}:' || tree::VARCHAR || ':' || id::VARCHAR || ':' || f::VARCHAR)) - 1 AS place
            FROM tot{d}, range({k}) r(f)),
split{d} AS MATERIALIZED (SELECT b.tree, b.id, b.f, b.t FROM best{d} b JOIN draw{d} USING (tree, id, f)
             QUALIFY row_number() OVER (PARTITION BY b.tree, b.id ORDER BY CASE WHEN place < {DRAWN} THEN 0 ELSE place END, gain DESC, b.f) = 1),
at{d + 1} AS MATERIALIZED (SELECT a.tree, CASE WHEN coalesce(a.x[s.f + 1] <= s.t, FALSE) THEN 2 * a.id + 1 ELSE 2 * a.id + 2 END AS id, a.rid, a.x, a.y
             FROM at{d} a JOIN split{d} s USING (tree, id))""")
    every = " UNION ALL ".join(f"""SELECT t.tree::INT AS tree, t.id, CASE WHEN s.f IS NULL THEN -1 ELSE 2 * t.id + 1 END AS "left",
        CASE WHEN s.f IS NULL THEN -1 ELSE 2 * t.id + 2 END AS "right", coalesce(s.f, -1)::INT AS feature, s.t AS threshold,
        t.n - t.p AS neg, t.p AS pos FROM tot{d} t LEFT JOIN split{d} s USING (tree, id)""" for d in range(LEVELS))
    return ",".join(parts) + f", nodes AS MATERIALIZED ({every})"


def forest_sql() -> dict[str, str]:
    head = base_ctes().replace("WITH ", "WITH RECURSIVE ", 1)
    names = "[" + ", ".join(f"'{c}'" for c in RULE_COLS) + "]"
    return {
        "forest_nodes": f"{head}, {forest_ctes()} SELECT * FROM nodes",
        "forest_predicates": f"""{head}, {forest_ctes()},
            kid AS (SELECT tree, id, pos::DOUBLE / (pos + neg) AS pr FROM nodes),
            inner_ AS (SELECT n.tree, n.id, n."left" AS lc, n."right" AS rc, {names}[n.feature + 1] AS col, l.pr - r.pr AS score, n.threshold + 1 AS t1
                       FROM nodes n JOIN kid l ON l.tree = n.tree AND l.id = n."left" JOIN kid r ON r.tree = n.tree AND r.id = n."right"),
            pred AS (SELECT *, CASE WHEN score >= 0 THEN 0.0::DOUBLE ELSE t1 END AS lo, CASE WHEN score >= 0 THEN t1 ELSE 1000000.0::DOUBLE END AS hi FROM inner_),
            paths(tree, id, lc, rc, text, col, lo, hi, score) AS (
              SELECT tree, id, lc, rc, col || ' in [' || lo::VARCHAR || ', ' || hi::VARCHAR || ')', col, lo, hi, abs(score) FROM pred WHERE id = 0
              UNION ALL
              SELECT p.tree, p.id, p.lc, p.rc, q.text || ' AND ' || p.col || ' in [' || p.lo::VARCHAR || ', ' || p.hi::VARCHAR || ')',
                     p.col, p.lo, p.hi, abs(p.score)
              FROM paths q JOIN pred p ON p.tree = q.tree AND (p.id = q.lc OR p.id = q.rc)),
            one AS (SELECT * FROM paths QUALIFY row_number() OVER (PARTITION BY col, lo, hi ORDER BY score DESC, tree, id) = 1)
            SELECT row_number() OVER (ORDER BY score DESC, tree, id)::INT AS rank, text AS predicate, col, lo, hi, round(score, 6) AS score, tree, id
            FROM one QUALIFY rank <= 10""",
    }


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out.update(forest_sql())
    out.update(reshape_sql())
    out.update(scoring_sql())
    out.update(ruleset_sql())
    out.update(search_sql())
    out.update(meanshift_sql())
    out.update(ruleset_neighbour_sql())
    return out
