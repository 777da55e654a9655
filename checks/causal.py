"""Root causes, graph work, blast radius, comparisons and reports."""

from pyspark.sql import functions as F

from checks.business import _LAST, AS_OF, LONG, scored_sql
from checks.shared import keep
from checks.detect import EV_MAP, PAIR_SQL, gold_table, inc_sql, pairs, panel_incidents, panel_types, r, text_date, LOOK
from panelwise import config
from panelwise.operators import blast, cascades, causes, health, ranking, reports
from panelwise.session import cut_lineage
from panelwise.sources import star

QUERIES, SQL = {}, {}


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


EDGES = "ed(s, t) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in config.METRIC_EDGES) + ")"
CLOSURE = f"""{EDGES}, wk AS (SELECT t AS m, s AS u, 1 AS h, [s, t] AS p FROM ed UNION ALL SELECT m, ed.s, h + 1, [ed.s] || p FROM wk JOIN ed ON ed.t = wk.u),
cl AS (SELECT m, u, min(h) AS h, arg_min(p, lpad(h::VARCHAR, 3, '0') || array_to_string(p, ',')) AS p FROM wk GROUP BY 1, 2 UNION ALL SELECT n, n, 0, [n] FROM (SELECT s AS n FROM ed UNION SELECT t FROM ed))"""


def graph_values(s, d):
    """The metric graph with the value every metric has on the reporting day."""
    return ranking.latest_by_metric(gold_table(s, d), AS_OF).select("metric_name", "metric_value")


def _closure(s, d):
    c = causes.graph_closure(causes.metric_edges(s)).withColumn("path", F.concat_ws(">", "path"))
    v = graph_values(s, d).withColumnRenamed("metric_name", "upstream")
    return r(c.join(v, "upstream"), "proximity", "metric_value")


add("r1_graph_closure", _closure, f"""WITH RECURSIVE {LONG}, {_LAST}, {CLOSURE}
SELECT cl.m AS metric, u AS upstream, h AS hops, array_to_string(p, '>') AS path, round(CASE WHEN h = 0 THEN 1 ELSE 1.0 / (h + 1) END, 4)::DOUBLE AS proximity, round(v, 4) AS metric_value FROM cl JOIN lv ON lv.m = u""")


def strengths(s, d):
    """Edge strengths from the data: absolute correlation of the two daily series, floored at 0.1."""
    g = gold_table(s, d).where("metric_value is not null")
    e = F.broadcast(causes.metric_edges(s))
    a = g.withColumnRenamed("metric_name", "src").withColumnRenamed("metric_value", "x")
    b = g.withColumnRenamed("metric_name", "dst").withColumnRenamed("metric_value", "y")
    return a.join(e, "src").join(b, ["dst", "metric_date"]).groupBy("src", "dst").agg(
        F.greatest(F.lit(0.1), F.least(F.lit(0.99), F.abs(F.coalesce(F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")), F.lit(0.0))))).alias("strength"))


def _learned(s, d):
    c = causes.graph_closure(causes.metric_edges(s))
    return r(causes.learned_proximity(c, strengths(s, d)), "proximity", "path_strength", "learned_proximity", digits=5)


add("r2_learned_proximity", _learned, f"""WITH RECURSIVE {LONG}, {CLOSURE},
st AS (SELECT s, t, greatest(.1, least(.99, abs(CASE WHEN isnan(corr(a.v, b.v)) THEN 0 ELSE coalesce(corr(a.v, b.v), 0) END))) AS k FROM ed JOIN gold a ON a.m = s JOIN gold b ON b.m = t AND a.d = b.d WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY 1, 2),
sp AS (SELECT m, u, h, p[i] AS s, p[i + 1] AS t FROM cl, range(1, 20) q(i) WHERE h > 0 AND i <= h), g AS (SELECT m, u, any_value(1.0::DOUBLE / (h + 1)) AS px, exp(avg(ln(coalesce(k, 1)))) AS ps FROM sp LEFT JOIN st USING (s, t) GROUP BY 1, 2)
SELECT m AS metric, u AS upstream, round(px, 5) AS proximity, round(ps, 5) AS path_strength, round(px * ps, 5) AS learned_proximity FROM g""")

# --- candidates -----------------------------------------------------------------------
_TM = "tm(t, target) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in config.INCIDENT_METRIC.items()) + ")"
SERIES = """sr AS (SELECT m, d, list(v) FILTER (WHERE v IS NOT NULL) OVER (PARTITION BY m ORDER BY d ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS l FROM gold),
s1 AS (SELECT m, d, l, len(l) AS n, l[-1] AS cur, list_aggregate(l, 'median') AS med, list_aggregate(l, 'stddev_pop') AS sd FROM sr WHERE len(l) >= 3),
s2 AS (SELECT *, list_aggregate(list_transform(l, lambda x: abs(x - med)), 'median') AS mad FROM s1),
s3 AS (SELECT *, CASE WHEN mad >= 1e-10 THEN .6745 * (cur - med) / mad WHEN sd < 1e-10 THEN 0 ELSE (cur - med) / sd END AS z, CASE WHEN mad >= 1e-10 THEN mad WHEN sd > 1e-10 THEN sd / .6745 ELSE 1 END AS scl FROM s2),
s4 AS (SELECT *, greatest(1, n - coalesce(list_max(list_filter(range(1, n + 1), lambda i: abs(.6745 * (l[i] - med) / scl) < 2)), 0)) AS ad, CASE WHEN n / 15.0 >= .9 THEN 1 WHEN n / 15.0 >= .7 THEN .9 WHEN n / 15.0 >= .5 THEN .75 ELSE .5 END::DOUBLE AS q FROM s3)"""


def series(s, d):
    return causes.window_series(gold_table(s, d))


add("r4_candidate_stats", lambda s, d: r(text_date(causes.candidate_stats(series(s, d)).select("metric_name", "metric_date", "current_value", "baseline", "zscore")), "current_value", "baseline", "zscore", digits=7),
    f"WITH {LONG}, {SERIES} SELECT m AS metric_name, strftime(d, '%Y-%m-%d') AS metric_date, round(cur, 7) AS current_value, round(med, 7) AS baseline, round(z, 7) AS zscore FROM s4")
add("r5_anomaly_window", lambda s, d: text_date(causes.candidate_stats(series(s, d)).select("metric_name", "metric_date", "anomalous_days", "anomaly_start"), "metric_date", "anomaly_start"),
    f"WITH {LONG}, {SERIES} SELECT m AS metric_name, strftime(d, '%Y-%m-%d') AS metric_date, CAST(ad AS INTEGER) AS anomalous_days, strftime(d - CAST(ad - 1 AS INTEGER), '%Y-%m-%d') AS anomaly_start FROM s4")


def cands(s, d):
    return keep(("candidates", d), lambda: _cands(s, d))


def _cands(s, d):
    return causes.candidates(panel_incidents(s, d), gold_table(s, d), causes.metric_edges(s))


CANDS = f"""{inc_sql()}, {SERIES}, {CLOSURE}, {_TM},
ca0 AS (SELECT id, inc.d, target, u AS m, 1.0::DOUBLE / (h + 1) AS px, c.l AS x, y.l AS y, c.z, c.q, c.cur, c.med FROM inc JOIN tm USING (t) JOIN cl ON cl.m = target AND h > 0 JOIN s4 c ON c.m = u AND c.d = inc.d
  JOIN sr y ON y.m = target AND y.d = inc.d WHERE abs(c.z) >= 2 AND len(y.l) >= 3),
ca1 AS (SELECT *, least(len(x), len(y)) AS n FROM ca0), ca2 AS (SELECT * EXCLUDE (x, y), x[len(x) - n + 1:] AS x, y[len(y) - n + 1:] AS y, least(14, n - 1) AS top FROM ca1),
ca3 AS (SELECT id, m, k, n - k AS ov, corr(x[i], y[i + k]) AS r, var_pop(x[i]) AS vx, var_pop(y[i + k]) AS vy FROM ca2, range(0, 15) a(k), range(1, 16) b(i) WHERE k <= top AND i <= n - k GROUP BY id, m, k, n),
ca4 AS (SELECT id, m, max({{'r': round(r, 9), 'g': -k}}) AS b FROM ca3 JOIN ca2 USING (id, m) WHERE ov >= 3 AND vx > 1e-12 * list_aggregate(x, 'var_pop') AND vy > 1e-12 * list_aggregate(y, 'var_pop') AND list_aggregate(x, 'stddev_pop') >= 1e-10 AND list_aggregate(y, 'stddev_pop') >= 1e-10 GROUP BY id, m),
ca5 AS (SELECT ca2.*, CASE WHEN b.r IS NULL THEN 0 ELSE .6 * least(1, abs(b.r)) + .4 * CASE WHEN b.g < 0 THEN least(1, -b.g / top::DOUBLE) ELSE .5 END END AS pr, coalesce(-b.g, 0) AS lg, coalesce(b.r, 0) AS mr, coalesce(abs(b.r) >= .3, false) AS sg FROM ca2 LEFT JOIN ca4 USING (id, m)),
ca AS (SELECT *, round(.3 / (1 + exp(-.5 * (abs(z) - 3))) + .3 * pr + .25 * px + .15 * q, 4) AS score FROM ca5)"""
add("r3_temporal_precedence", lambda s, d: r(cands(s, d).select("incident_id", "metric_name", "precedence", "optimal_lag", "max_correlation", "significant"), "precedence", "max_correlation"),
    f"WITH RECURSIVE {CANDS} SELECT id AS incident_id, m AS metric_name, round(pr, 4) AS precedence, CAST(lg AS INTEGER) AS optimal_lag, round(mr, 4) AS max_correlation, sg AS significant FROM ca")


def _evidence(s, d):
    return r(text_date(causes.evidence_clusters(cands(s, d), star.order_panel_events(s, d)).drop("sample_event_id")), "total_amount", digits=5)


_ME = "me(m, et) AS (VALUES " + ", ".join(f"('{k}', '{e}')" for k, v in config.METRIC_EVENTS.items() for e in v) + ")"
add("r6_evidence_clusters", _evidence, f"""WITH RECURSIVE {CANDS}, {_ME}, dy AS (SELECT event_type, d, count(*) AS n, sum(amount) AS a FROM ev GROUP BY 1, 2)
SELECT c.m AS metric_name, strftime(c.d, '%Y-%m-%d') AS metric_date, et AS event_type, CAST(sum(n) AS BIGINT) AS event_count, round(sum(a), 5) AS total_amount FROM (SELECT DISTINCT m, d FROM ca) c JOIN me USING (m) JOIN dy ON dy.event_type = et AND dy.d BETWEEN c.d - 14 AND c.d GROUP BY 1, 2, 3""")
add("r7_rank_causes", lambda s, d: causes.rank_causes(cands(s, d)).select("incident_id", "metric_name", "score", "rank"),
    f"WITH RECURSIVE {CANDS} SELECT * FROM (SELECT id AS incident_id, m AS metric_name, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, m) AS rank FROM ca) WHERE rank <= 5")
add("r8_relative_importance", lambda s, d: r(causes.relative_importance(causes.rank_causes(cands(s, d))).select("incident_id", "metric_name", "importance_pct"), "importance_pct"),
    f"""WITH RECURSIVE {CANDS}, rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, m) AS k FROM ca) SELECT id AS incident_id, m AS metric_name, round(score * 100 / sum(score) OVER (PARTITION BY id), 4) AS importance_pct FROM rk WHERE k <= 5""")
_U4 = ", ".join(f"(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE AS u{i}" for i in range(4))
_ANY = "least(1, greatest(0, {}))"
add("r9_bootstrap_ci", lambda s, d: r(causes.bootstrap_ci(cands(s, d)), "ci_lower", "ci_upper", "std_error", digits=7),  # interpolated in steps of 2.5e-6
    f"""WITH RECURSIVE {CANDS}, b1 AS (SELECT id, m, score, z, pr, px, q, md5('7:' || id || ':' || m || ':' || k) AS h FROM ca, range(1, 201) t(k)), b2 AS (SELECT *, {_U4} FROM b1),
b3 AS (SELECT *, z * (1 + .05::DOUBLE * sqrt(-2 * ln(u0)) * cos(2 * pi() * u1)) AS z1, pr * (1 + .05::DOUBLE * sqrt(-2 * ln(u0)) * sin(2 * pi() * u1)) AS p1,
  px * (1 + .05::DOUBLE * sqrt(-2 * ln(u2)) * cos(2 * pi() * u3)) AS x1, q * (1 + .05::DOUBLE * sqrt(-2 * ln(u2)) * sin(2 * pi() * u3)) AS q1 FROM b2),
b4 AS (SELECT id, m, any_value(score) AS score, round({_ANY.format(f".3 / (1 + exp(-.5 * (abs(z1) - 3))) + .3 * {_ANY.format('p1')} + .25 * {_ANY.format('x1')} + .15 * {_ANY.format('q1')}")}, 4) AS s FROM b3 GROUP BY id, m, h, z1, p1, x1, q1)
SELECT id AS incident_id, m AS metric_name, any_value(score) AS point_estimate, round(quantile_cont(s, .025), 7) AS ci_lower, round(quantile_cont(s, .975), 7) AS ci_upper,
  round(stddev_samp(s), 7) AS std_error, quantile_cont(s, .025) > .05 AS significant FROM b4 GROUP BY id, m""")
_W = []
for _n in config.CAUSE_WEIGHTS:
    for _dl in (0.05, -0.05, 0.10, -0.10):
        _w = dict(config.CAUSE_WEIGHTS)
        _w[_n] = max(0.01, _w[_n] + _dl)
        _t = sum(_w.values())
        _W.append({k: v / _t for k, v in _w.items()})
_GRID = "wg(g, wa, wt, wp, wq) AS (VALUES " + ", ".join(f"({i}, {w['anomaly']!r}::DOUBLE, {w['temporal']!r}::DOUBLE, {w['proximity']!r}::DOUBLE, {w['quality']!r}::DOUBLE)" for i, w in enumerate([config.CAUSE_WEIGHTS, *_W])) + ")"
add("r10_weight_sensitivity", lambda s, d: r(causes.sensitivity(cands(s, d)).withColumn("alternatives", F.concat_ws(",", "alternatives")), "rank_stability"),
    f"""WITH RECURSIVE {CANDS}, {_GRID}, sc AS (SELECT g, id, m, round(wa / (1 + exp(-.5 * (abs(z) - 3))) + wt * pr + wp * px + wq * q, 4) AS s FROM ca, wg), tp AS (SELECT g, id, m FROM (SELECT *, row_number() OVER (PARTITION BY g, id ORDER BY s DESC, m) AS k FROM sc) WHERE k = 1),
o AS (SELECT a.id, a.m, avg((b.m = a.m)::INT) AS st, coalesce(string_agg(DISTINCT b.m, ',' ORDER BY b.m) FILTER (b.m <> a.m), '') AS alt FROM tp a JOIN tp b ON a.id = b.id AND b.g > 0 WHERE a.g = 0 GROUP BY 1, 2)
SELECT id AS incident_id, m AS top_cause, round(st, 4) AS rank_stability, CASE WHEN st >= .85 THEN 'high' WHEN st >= .6 THEN 'medium' ELSE 'low' END AS robustness, alt AS alternatives FROM o""")


def all_causes(s, d):
    return causes.root_causes(panel_incidents(s, d), cands(s, d), causes.metric_edges(s))


def _told(metric, depth, seen):
    """The chain of a metric, by recursion (the operator walks with a stack)."""
    seen.add(metric)
    out = []
    for a, b in config.METRIC_EDGES:
        if b == metric and a not in seen and depth < 4:
            out += _told(a, depth + 1, seen)
    return out + [metric]


def _chain_rows():
    for m in sorted(set(config.INCIDENT_METRIC.values())):
        chain = _told(m, 0, set())
        if len(chain) == 1:
            chain += [b for a, b in config.METRIC_EDGES if a == m][:1]
        yield from (f"('{m}', {i}, '{x}', {0.95 if x == m else max(0.1, 0.9 - 0.15 * (i - 1))}::DOUBLE)" for i, x in enumerate(chain, 1))


CAUSES = f"""{CANDS}, rk AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY score DESC, m) AS k, m, score, 'statistical' AS meth FROM ca),
ch(target, k, m, sc) AS (VALUES {", ".join(_chain_rows())}),
rc AS (SELECT * FROM rk WHERE k <= 5 UNION ALL SELECT id, k, ch.m, sc, 'graph' FROM inc JOIN tm USING (t) JOIN ch USING (target) WHERE id NOT IN (SELECT id FROM ca))"""
add("r11_root_causes", lambda s, d: r(all_causes(s, d), "score"), f"WITH RECURSIVE {CAUSES} SELECT id AS incident_id, CAST(k AS INTEGER) AS rank, m AS metric_name, round(score, 4) AS score, meth AS method FROM rc")

# --- blast radius --------------------------------------------------------------------------
add("j2_followups", lambda s, d: blast.followups(panel_incidents(s, d)),
    f"WITH {inc_sql()} SELECT a.id AS incident_id, b.id AS followup_id FROM inc a JOIN inc b ON b.det > a.det AND b.det < a.det + INTERVAL 48 HOUR")


def spine_of(s, d):
    return gold_table(s, d).select("metric_date").distinct()


def _impact(s, d):
    ev = star.order_panel_events(s, d, linked=True)
    spine = spine_of(s, d)
    inc = panel_incidents(s, d)
    return inc, blast.impact(inc, ev, spine, types=panel_types(s, d))


_ENT = """en AS (SELECT DISTINCT d, k, e FROM (SELECT d, entity_type AS k, entity_id AS e FROM ev UNION ALL SELECT d, 'customer', customer FROM ev UNION ALL SELECT d, 'vendor', vendor FROM ev
  UNION ALL SELECT d, 'product', product FROM ev UNION ALL SELECT d, 'order', ord FROM ev) WHERE e IS NOT NULL AND k IN ('customer', 'order', 'product', 'vendor')),
idays AS (SELECT DISTINCT d FROM inc), af AS (SELECT i.d, count(DISTINCT e) FILTER (k = 'customer') AS c, count(DISTINCT e) FILTER (k = 'order') AS o, count(DISTINCT e) FILTER (k = 'product') AS p, count(DISTINCT e) FILTER (k = 'vendor') AS v
  FROM idays i JOIN en ON en.d BETWEEN i.d - 30 AND i.d GROUP BY i.d)"""


def _affected(s, d):
    ev = star.order_panel_events(s, d, linked=True)
    return blast.affected_entities(panel_incidents(s, d), ev, spine_of(s, d))


add("b1_affected_entities", _affected, f"WITH {inc_sql()}, {_ENT} SELECT id AS incident_id, c AS customers_affected, af.o AS orders_affected, p AS products_affected, v AS vendors_affected FROM inc JOIN af USING (d)")
IMPACT = f"""{_ENT}, im AS (SELECT i.d, coalesce(sum(amount) FILTER (event_type IN ('invoice_paid', 'payment_received', 'invoice_issued')), 0) AS rev, coalesce(sum(amount) FILTER (event_type IN ('refund_issued', 'credit_memo_issued')), 0) AS ref,
  coalesce(sum(amount), 0) AS al, coalesce(avg(amount) FILTER (event_type IN ('order_placed', 'invoice_issued')), 0) AS av FROM idays i JOIN ev ON ev.d BETWEEN i.d - 30 AND i.d GROUP BY i.d),
bl AS (SELECT inc.*, rev, ref, al, av, c, af.o AS oa, p, v, floor(c * .06::DOUBLE * CASE t WHEN 'churn_acceleration' THEN 2 WHEN 'customer_satisfaction_regression' THEN 2 WHEN 'refund_spike' THEN 1.5 ELSE 1 END::DOUBLE)::BIGINT AS ce FROM inc JOIN im USING (d) JOIN af USING (d))"""
add("b2_impact", lambda s, d: r(_impact(s, d)[1].select("incident_id", "revenue_exposure", "refund_exposure", "total_event_amount", "avg_order_value", "churn_exposure"), "revenue_exposure", "refund_exposure", "total_event_amount", "avg_order_value", digits=5),
    f"WITH {inc_sql()}, {IMPACT} SELECT id AS incident_id, round(rev, 5) AS revenue_exposure, round(ref, 5) AS refund_exposure, round(al, 5) AS total_event_amount, round(av, 5) AS avg_order_value, ce AS churn_exposure FROM bl")


def blasts(s, d):
    return keep(("blast", d), lambda: _blasts(s, d))


def _blasts(s, d):
    inc, imp = _impact(s, d)
    return blast.blast_severity(imp, blast.followups(inc))


LADDER = f"""{IMPACT}, fo AS (SELECT a.id, count(b.id) AS n FROM inc a LEFT JOIN inc b ON b.det > a.det AND b.det < a.det + INTERVAL 48 HOUR GROUP BY a.id),
bs AS (SELECT bl.*, n AS dn, CASE {" ".join(f"WHEN c >= {c} OR rev >= {rv} OR ref >= {rf} OR n >= {dn} THEN '{nm}'" for nm, c, rv, rf, dn in config.BLAST_LADDER)} ELSE 'contained' END AS bsv FROM bl JOIN fo USING (id))"""
add("b3_blast_severity", lambda s, d: blasts(s, d).select("incident_id", "downstream_count", "blast_severity"), f"WITH {inc_sql()}, {LADDER} SELECT id AS incident_id, dn AS downstream_count, bsv AS blast_severity FROM bs")


def _reach(s, d):
    ev = star.order_events(s, d)
    seeds = star.table(s, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("customer:shop:"), "c_custkey").alias("seed"))
    return blast.entity_reach(ev, seeds, 5).groupBy("seed", "hops").agg(F.count("*").alias("n"))


add("b4_entity_reach", _reach, """WITH s AS (SELECT c_custkey AS c FROM customer WHERE c_acctbal < 0)
SELECT 'customer:shop:' || c AS seed, 0 AS hops, 1::BIGINT AS n FROM s UNION ALL SELECT 'customer:shop:' || c, 1, 2 * count(*) FROM s JOIN orders ON o_custkey = c GROUP BY c""")
add("b5_blast_edges", lambda s, d: blast.blast_edges(panel_incidents(s, d), star.order_panel_events(s, d)).groupBy("relation").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.count_distinct("target").alias("targets")),
    f"""WITH {inc_sql()}, {EV_MAP}, hh AS (SELECT id, ev.* FROM inc JOIN em USING (t) JOIN ev ON ev.event_type = et AND ev.d = inc.d),
x AS (SELECT DISTINCT * FROM (SELECT id AS s, entity_id AS t, 'affects' AS r FROM hh UNION ALL SELECT entity_id, customer, 'customer' FROM hh UNION ALL SELECT entity_id, vendor, 'vendor' FROM hh UNION ALL SELECT entity_id, product, 'product' FROM hh UNION ALL SELECT entity_id, ord, 'order' FROM hh) WHERE t IS NOT NULL)
SELECT r AS relation, count(*) AS n, count(DISTINCT s) AS sources, count(DISTINCT t) AS targets FROM x GROUP BY r""")


def _subgraph(s, d):
    status = health.metric_scores(ranking.latest_by_metric(gold_table(s, d), AS_OF)).select("metric_name", "status")
    return causes.causal_subgraph(panel_incidents(s, d), causes.metric_edges(s), status).groupBy("src", "dst", "impact").agg(F.count("*").alias("incidents"))


add("b6_causal_subgraph", _subgraph, f"""WITH RECURSIVE {inc_sql()}, {CLOSURE}, {_TM}, {_LAST}, {scored_sql('lv').replace('sc AS (', 'scr AS (')}, bad AS (SELECT m FROM scr WHERE s < .8),
c0 AS (SELECT m, u AS n FROM cl), c1 AS (SELECT m, t AS n FROM c0 JOIN ed ON s = n), c2 AS (SELECT m, t AS n FROM c1 JOIN ed ON s = n), ns AS (SELECT * FROM c0 UNION SELECT * FROM c1 UNION SELECT * FROM c2),
sb AS (SELECT a.m, ed.s, ed.t FROM ns a JOIN ed ON ed.s = a.n JOIN ns b ON b.m = a.m AND b.n = ed.t)
SELECT sb.s AS src, sb.t AS dst, CASE WHEN sb.t IN (SELECT m FROM bad) THEN 'negative' ELSE 'static' END AS impact, count(*) AS incidents FROM inc JOIN tm USING (t) JOIN sb ON sb.m = target GROUP BY 1, 2, 3""")


def _chains(s, d):
    ch = causes.forward_chains(causes.metric_edges(s))
    v = graph_values(s, d).withColumnRenamed("metric_name", "start_metric")
    return r(ch.join(v, "start_metric").withColumn("path", F.concat_ws(">", "path")), "metric_value")


add("b7_forward_chains", _chains, f"""WITH RECURSIVE {LONG}, {_LAST}, {EDGES}, {_TM}, fw AS (SELECT n AS a, [n] AS p FROM (SELECT s AS n FROM ed UNION SELECT t FROM ed) UNION ALL SELECT t, p || [t] FROM fw JOIN ed ON s = a WHERE len(p) < 5 AND a NOT IN (SELECT target FROM tm))
SELECT p[1] AS start_metric, tm.t AS incident_type, array_to_string(p, '>') AS path, round(v, 4) AS metric_value FROM fw JOIN tm ON target = a JOIN lv ON lv.m = p[1]""")


# --- comparison and reports --------------------------------------------------------------------
def _compare(s, d):
    inc = panel_incidents(s, d, LOOK)
    tops = causes.rank_causes(causes.candidates(inc, gold_table(s, d), causes.metric_edges(s))).groupBy("incident_id").agg(F.collect_set("metric_name").alias("causes"))
    b = blasts(s, d).select("incident_id", "customers_affected", "revenue_exposure")
    facts = cut_lineage(inc.select("incident_id", "severity", "primary_zscore").join(tops, "incident_id", "left").join(b, "incident_id")
                        .withColumn("causes", F.coalesce("causes", F.array().cast("array<string>"))))
    out = cascades.compare_incidents(pairs(s, d).select("a_id", "b_id"), facts)
    for c in ("shared_causes", "only_a", "only_b"):
        out = out.withColumn(c, F.concat_ws(",", c))
    return r(out, "zscore_ratio", "customer_ratio", "revenue_ratio")


def _lst(x):
    return f"coalesce(array_to_string(list_sort({x}), ','), '')"


add("c5_compare_incidents", _compare, f"""WITH RECURSIVE {PAIR_SQL}, {IMPACT}, {CANDS[len(inc_sql()) + 2:].replace("sc AS (", "sc9 AS (")},
tc AS (SELECT id, list(m) AS l FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, m) AS k FROM ca) WHERE k <= 5 GROUP BY id),
fx AS (SELECT bl.id, sev, pz, bl.c, rev, coalesce(l, []) AS l, CASE sev WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END AS rk FROM bl LEFT JOIN tc USING (id))
SELECT a_id, b_id, {_lst('list_intersect(a.l, b.l)')} AS shared_causes, {_lst('list_filter(a.l, lambda x: NOT list_contains(b.l, x))')} AS only_a, {_lst('list_filter(b.l, lambda x: NOT list_contains(a.l, x))')} AS only_b,
  CASE WHEN a.rk > b.rk THEN 'a_more_severe' WHEN a.rk < b.rk THEN 'b_more_severe' ELSE 'equal' END AS severity_relation, round(abs(a.pz) / greatest(abs(b.pz), .001), 4) AS zscore_ratio,
  round(a.c / greatest(b.c, 1)::DOUBLE, 4) AS customer_ratio, round(a.rev / greatest(b.rev, .01), 4) AS revenue_ratio FROM cp JOIN fx a ON a.id = a_id JOIN fx b ON b.id = b_id""")


def _postmortems(s, d):
    return reports.postmortems(panel_incidents(s, d), all_causes(s, d), blasts(s, d))


PM = f"""{CAUSES}, {LADDER}, cc AS (SELECT id, max(m) FILTER (k = 1) AS rm, coalesce(string_agg(m, ',' ORDER BY k) FILTER (k IN (2, 3)), '') AS cf FROM rc GROUP BY id),
cap(t, w) AS (VALUES {", ".join(f"('{m}', '{m.replace('_', ' ').title()}')" for m in sorted(set(config.METRICS) | set(config.INCIDENT_METRIC)))}),
pm AS (SELECT bs.id, bs.det, sev, a.w || ' Incident' || ' - Root Cause: ' || b.w AS title, '1.0 days' AS duration, replace(bs.t, '_', ' ') || ' affecting ' || c || ' customers, ' || CAST(trunc(round(rev, 2)) AS BIGINT) || ' in revenue at risk' AS summary, rm, cf,
  concat_ws('|', CASE WHEN sev IN ('high', 'critical') THEN 'Escalate to management' END, CASE WHEN ce > 10 THEN 'Start a retention campaign for the customers at risk' END, CASE WHEN ref > 10000 THEN 'Reserve funds for refunds' END, 'Deploy the recommended monitors') AS rec, rev, ce
  FROM bs JOIN cc USING (id) JOIN cap a ON a.t = bs.t JOIN cap b ON b.t = rm)"""
add("f17_postmortems", lambda s, d: _postmortems(s, d).select("incident_id", "severity", "title", "duration", "summary", "root_cause", F.concat_ws(",", "contributing_factors").alias("contributing_factors"),
                                                             F.concat_ws("|", "recommendations").alias("recommendations"), F.size("timeline").alias("timeline_entries")),
    f"WITH RECURSIVE {PM} SELECT id AS incident_id, sev AS severity, title, duration, summary, rm AS root_cause, cf AS contributing_factors, rec AS recommendations, 2 AS timeline_entries FROM pm")


def _feed(s, d):
    scores = health.metric_scores(ranking.latest_by_metric(gold_table(s, d), AS_OF))
    inc = panel_incidents(s, d)
    b = blasts(s, d).join(inc.select("incident_id", "detected_at"), "incident_id")
    return reports.recommendations(scores, _postmortems(s, d), b, n=12)


_ACT = "act(m, a) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in reports.METRIC_ACTIONS.items()) + ")"
add("f16_recommendations", _feed, f"""WITH RECURSIVE {PM}, {_LAST}, {scored_sql('lv')}, {_ACT},
al AS (SELECT a AS action, 'metric' AS source, CASE WHEN s < .2 THEN 1 ELSE 2 END AS priority FROM sc JOIN act USING (m) WHERE s < .5
UNION ALL SELECT unnest(string_split(rec, '|')[1:2]), 'postmortem', 2 FROM pm
UNION ALL SELECT CASE WHEN rev > 5000 THEN '{reports.REVENUE_ACTION}' ELSE '{reports.CHURN_ACTION}' END, 'blast_radius', CASE WHEN rev > 5000 THEN 1 ELSE 2 END FROM pm WHERE rev > 5000 OR ce > 3)
SELECT action, source, priority FROM (SELECT *, row_number() OVER (PARTITION BY substr(action, 1, 50), source ORDER BY priority, action) AS k FROM al) WHERE k = 1 ORDER BY priority, action LIMIT 12""")
