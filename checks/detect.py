"""Anomaly detection, incident rules and cascades on the order panel."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from checks.shared import keep
from checks.views import MONEY, PANEL, SUPPORT, with_rolled, with_wide
from panelwise import config
from panelwise.operators import cascades, daily, detection, graph, incidents, ordering
from panelwise.sources import star

QUERIES, SQL = {}, {}

PANEL_METRICS = [m for m in config.METRICS if m not in ("review_score_trend", "churn_proxy", "customer_concentration")]
MONEY_METRICS = ["daily_revenue", "daily_expenses", "daily_refunds", "refund_rate", "net_cash_proxy", "expense_ratio",
                 "margin_proxy", "ar_aging_amount"]


def long_panel(s, d, metrics=PANEL_METRICS, view=star.order_panel_events):
    return daily.to_long(daily.rolling_gold(view(s, d), metrics), keep_nulls=True)


def money_long(s, d):
    return long_panel(s, d, MONEY_METRICS, star.money_events)


def text_date(df, *cols):
    for c in cols or ("metric_date",):
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd"))
    return df


def r(df, *cols, digits=4):
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


def long_sql(events=PANEL, metrics=PANEL_METRICS):
    """CTEs up to gold(d, m, v), NULLs kept."""
    union = " UNION ALL ".join(f"SELECT d, '{m}' AS m, {m}::DOUBLE AS v FROM rolled" for m in metrics)
    return f"{with_rolled(events)}, gold AS ({union})"


Z = """h AS (SELECT m, d, v, list(v) FILTER (WHERE v IS NOT NULL) OVER (PARTITION BY m ORDER BY d ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS l FROM gold),
h2 AS (SELECT *, coalesce(len(l), 0) AS n, list_aggregate(l, 'median') AS med FROM h WHERE v IS NOT NULL),
h3 AS (SELECT *, list_aggregate(list_transform(l, lambda x: abs(x - med)), 'median') AS mad FROM h2),
z AS (SELECT m, d, v, coalesce(med, v) AS med, coalesce(mad, 0) AS mad, n,
  CASE WHEN n = 0 THEN 0 WHEN mad = 0 THEN CASE WHEN abs(v - med) > 1e-10 THEN CASE WHEN v > med THEN 10 ELSE -10 END ELSE 0 END
    ELSE 0.6745 * (v - med) / mad END::DOUBLE AS z FROM h3),
zz AS (SELECT *, abs(z) > 3 AS f FROM z)"""


def _z_out(df):
    return r(r(text_date(df), "metric_value", "median", "mad", "zscore", digits=8))


_Z_SELECT = """SELECT m AS metric_name, strftime(d, '%Y-%m-%d') AS metric_date, round(v, 8) AS metric_value, round(med, 8) AS median,
  round(mad, 8) AS mad, CAST(n AS INTEGER) AS baseline_count, round(z, 8) AS zscore, f AS is_anomaly FROM zz"""
QUERIES["d1a_mad_zscore_joined"] = lambda s, d: _z_out(detection.mad_zscore_joined(money_long(s, d)))
SQL["d1a_mad_zscore_joined"] = f"WITH {long_sql(MONEY, MONEY_METRICS)}, {Z} {_Z_SELECT}"
QUERIES["d1b_mad_zscore"] = lambda s, d: _z_out(detection.mad_zscore(long_panel(s, d)))
SQL["d1b_mad_zscore"] = f"WITH {long_sql()}, {Z} {_Z_SELECT}"

QUERIES["d2_baseline_stats"] = lambda s, d: r(detection.baseline_stats(long_panel(s, d)),
                                             "median", "mad", "mean", "std", "min", "max", digits=8)
SQL["d2_baseline_stats"] = f"""WITH {long_sql()}, g AS (SELECT *, median(v) OVER (PARTITION BY m) AS med FROM gold WHERE v IS NOT NULL)
SELECT m AS metric_name, round(any_value(med), 8) AS median, round(median(abs(v - med)), 8) AS mad, round(avg(v), 8) AS mean,
  round(stddev_pop(v), 8) AS std, round(min(v), 8) AS min, round(max(v), 8) AS max, count(*) AS count FROM g GROUP BY m"""

CP_METRICS = ["daily_revenue", "daily_refunds", "refund_rate", "margin_proxy"]
_DP = """s0 AS (SELECT m, d, v, v - avg(v) OVER (PARTITION BY m) AS c, row_number() OVER (PARTITION BY m ORDER BY d) AS i,
  count(*) OVER (PARTITION BY m) AS n FROM gold WHERE v IS NOT NULL),
s1 AS (SELECT m, i, n, sum(c) OVER w AS s, sum(c * c) OVER w AS q FROM s0 WINDOW w AS (PARTITION BY m ORDER BY d ROWS UNBOUNDED PRECEDING)),
cand AS (SELECT m, max(n) AS n, [0] || list(i ORDER BY i) AS ii, [0.0::DOUBLE] || list(s ORDER BY i) AS ss, [0.0::DOUBLE] || list(q ORDER BY i) AS qq
  FROM s1 WHERE i % 5 = 0 OR i = n GROUP BY m),
dp AS (SELECT m, 1 AS j, [0.0::DOUBLE] AS costs, [-1] AS prevs FROM cand WHERE n >= 10
  UNION ALL
  SELECT m, j + 1, costs || [b.c], prevs || [b.p] FROM (
    SELECT dp.m, j, costs, prevs, list_min(list_transform(range(0, j), lambda a: {'c':
      CASE WHEN ii[j + 1] - ii[a + 1] >= 5 THEN costs[a + 1] + (qq[j + 1] - qq[a + 1]) - (ss[j + 1] - ss[a + 1]) ** 2 / (ii[j + 1] - ii[a + 1]) + ln(n)
      ELSE 'inf'::DOUBLE END, 'p': CAST(a AS INTEGER)})) AS b
    FROM dp JOIN cand USING (m) WHERE j < len(ii))),
fin AS (SELECT m, arg_max(prevs, j) AS p FROM dp GROUP BY m),
walk AS (SELECT m, len(p) - 1 AS at, CAST([] AS BIGINT[]) AS br FROM fin
  UNION ALL SELECT w.m, p[w.at + 1], CASE WHEN p[w.at + 1] > 0 THEN [ii[p[w.at + 1] + 1]] || w.br ELSE w.br END
  FROM walk w JOIN fin USING (m) JOIN cand ON cand.m = w.m WHERE w.at > 0),
brk AS (SELECT cand.m, cand.n, coalesce(arg_max(br, len(br)), []) AS br FROM cand LEFT JOIN walk USING (m) GROUP BY 1, 2)"""


def _breaks(s, d):
    gold = long_panel(s, d, CP_METRICS, star.money_events)
    return gold, detection.changepoints(gold)


def _changepoints(s, d):
    return _breaks(s, d)[1].select("metric_name", "n", F.concat_ws(",", F.transform("breaks", lambda b: b.cast("string"))).alias("breaks"))


QUERIES["d3_changepoints"] = _changepoints
SQL["d3_changepoints"] = (f"WITH RECURSIVE {long_sql(MONEY, CP_METRICS)}, {_DP} "
                          "SELECT m AS metric_name, n, array_to_string(br, ',') AS breaks FROM brk")


def _regime(s, d):
    gold, br = _breaks(s, d)
    out = detection.regime_change(gold, br)
    return r(text_date(out, "change_date").withColumn("change_index", F.col("change_index").cast("long")),
             "before_mean", "after_mean", "mean_shift", "percent_change", digits=3)


QUERIES["d4_regime_change"] = _regime
SQL["d4_regime_change"] = f"""WITH RECURSIVE {long_sql(MONEY, CP_METRICS)}, {_DP},
seg AS (SELECT s0.m, s0.i - 1 AS i, d, v, len(list_filter(br, lambda b: b <= s0.i - 1)) AS g, len(br) AS last FROM s0 JOIN brk USING (m)),
mm AS (SELECT m, g, max(last) AS last, avg(v) AS mean, min(d) AS d0, min(i) AS i0 FROM seg GROUP BY 1, 2),
p AS (SELECT a.m, a.g, a.d0, a.i0, a.mean AS aft, coalesce(b.mean, a.mean) AS bef FROM mm a LEFT JOIN mm b ON a.m = b.m AND b.g = a.g - 1 WHERE a.g = a.last)
SELECT m AS metric_name, g > 0 AS has_change, CASE WHEN g > 0 THEN strftime(d0, '%Y-%m-%d') END AS change_date,
  CASE WHEN g > 0 THEN i0 END AS change_index, round(bef, 3) AS before_mean, round(aft, 3) AS after_mean, round(aft - bef, 3) AS mean_shift,
  round(CASE WHEN bef = 0 THEN 0 ELSE (aft - bef) * 100 / bef END, 3) AS percent_change,
  CASE WHEN abs(aft - bef) < .01 THEN 'stable' WHEN aft > bef THEN 'increase' ELSE 'decrease' END AS direction FROM p"""

QUERIES["d5_temporal_features"] = lambda s, d: r(text_date(detection.temporal_features(money_long(s, d))),
                                                "metric_value", "mean_7", "std_14", "wow_delta", digits=3)
SQL["d5_temporal_features"] = f"""WITH {long_sql(MONEY, MONEY_METRICS)}
SELECT m AS metric_name, strftime(d, '%Y-%m-%d') AS metric_date, round(v, 3) AS metric_value,
  round(coalesce(avg(v) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), v), 3) AS mean_7,
  round(coalesce(stddev_pop(v) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), 0), 3) AS std_14,
  round(v - coalesce(lag(v, 7) OVER w, v), 3) AS wow_delta FROM gold WINDOW w AS (PARTITION BY m ORDER BY d)"""

_UNI = f"""u0 AS (SELECT d, ({' + '.join(MONEY_METRICS)}) / {len(MONEY_METRICS)} AS x FROM rolled),
u1 AS (SELECT d, (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) AS value FROM u0),
u AS (SELECT d, value, avg(value) OVER w AS rolling_mean, stddev_pop(value) OVER w AS rolling_std, value - avg(value) OVER w AS deviation,
  coalesce(value - lag(value) OVER (ORDER BY d), 0) AS rate_of_change FROM u1 WINDOW w AS (ORDER BY d ROWS BETWEEN 10 PRECEDING AND CURRENT ROW))"""


def univariate(s, d):
    return detection.univariate_features(daily.rolling_gold(star.money_events(s, d), MONEY_METRICS), MONEY_METRICS)


_UCOLS = ["value", "rolling_mean", "rolling_std", "deviation", "rate_of_change"]
QUERIES["d6_univariate_features"] = lambda s, d: r(text_date(univariate(s, d)), *_UCOLS, digits=5)
SQL["d6_univariate_features"] = (f"WITH {with_rolled(MONEY)}, {_UNI} SELECT strftime(d, '%Y-%m-%d') AS metric_date, "
                                 + ", ".join(f"round({c}, 5) AS {c}" for c in _UCOLS) + " FROM u")


def detector_flags(s, d):
    """Three deterministic detectors on the univariate panel: level, deviation and jump beyond 3 spreads."""
    return flags_of(univariate(s, d))


def flags_of(u):
    return u.select("metric_date", F.inline(F.array(
        F.struct(F.lit("level").alias("detector"), (F.col("value") > 0.8).alias("flag")),
        F.struct(F.lit("deviation").alias("detector"), (F.abs("deviation") > 2 * F.col("rolling_std")).alias("flag")),
        F.struct(F.lit("jump").alias("detector"), (F.abs("rate_of_change") > 2 * F.col("rolling_std")).alias("flag")))))


_FLAGS = """fl AS (SELECT d, 'level' AS k, value > 0.8 AS f FROM u UNION ALL SELECT d, 'deviation', abs(deviation) > 2 * rolling_std FROM u
  UNION ALL SELECT d, 'jump', abs(rate_of_change) > 2 * rolling_std FROM u)"""
QUERIES["d10_vote"] = lambda s, d: r(text_date(detection.vote(detector_flags(s, d), ["metric_date"], 2,
                                                             {"level": 0.5, "deviation": 0.3, "jump": 0.2})), "weighted_score")
SQL["d10_vote"] = f"""WITH {with_rolled(MONEY)}, {_UNI}, {_FLAGS}
SELECT strftime(d, '%Y-%m-%d') AS metric_date, CAST(sum(f::INT) AS BIGINT) AS votes, count(*) AS detectors,
  round(sum(f::INT * CASE k WHEN 'level' THEN .5::DOUBLE WHEN 'deviation' THEN .3 ELSE .2 END), 4)::DOUBLE AS weighted_score, sum(f::INT) >= 2 AS is_anomaly FROM fl GROUP BY d"""


def _pseudo(s, d):
    u = univariate(s, d).select("metric_date", F.abs("deviation").alias("score"))
    return ordering.pseudo_labels(u, "score", 0.02)


QUERIES["d11_pseudo_labels"] = lambda s, d: r(text_date(_pseudo(s, d)), "score", digits=5)
SQL["d11_pseudo_labels"] = f"""WITH {with_rolled(MONEY)}, {_UNI}, q AS (SELECT quantile_cont(abs(deviation), .98) AS c FROM u)
SELECT strftime(d, '%Y-%m-%d') AS metric_date, round(abs(deviation), 5) AS score, abs(deviation) >= c AS label FROM u, q"""
QUERIES["d10_detector_weights"] = lambda s, d: r(detection.detector_weights(
    detector_flags(s, d), _pseudo(s, d).select("metric_date", "label"), ["metric_date"]), "f1", "weight")
SQL["d10_detector_weights"] = f"""WITH {with_rolled(MONEY)}, {_UNI}, {_FLAGS}, q AS (SELECT quantile_cont(abs(deviation), .98) AS c FROM u),
lab AS (SELECT d, abs(deviation) >= c AS y FROM u, q),
f1 AS (SELECT k, 2.0 * count(*) FILTER (f AND y) / nullif(2 * count(*) FILTER (f AND y) + count(*) FILTER (f AND NOT y) + count(*) FILTER (NOT f AND y), 0) AS f1
  FROM fl JOIN lab USING (d) GROUP BY k)
SELECT k AS detector, round(coalesce(f1, 0), 4)::DOUBLE AS f1, round(greatest(coalesce(f1, 0), .1) / sum(greatest(coalesce(f1, 0), .1)) OVER (), 4)::DOUBLE AS weight FROM f1"""


# --- incidents ---------------------------------------------------------------
def panel_types(s, d):
    """Daily sums per event type of the order panel: its events are read once for everything daily."""
    return keep(("type days", d), lambda: daily.type_days(star.order_panel_events(s, d)))


def gold_table(s, d):
    """The order panel as a written table, for queries that read it several times."""
    return keep(("gold", d), lambda: daily.to_long(daily.rolling_gold(star.order_panel_events(s, d), PANEL_METRICS, types=panel_types(s, d)), keep_nulls=True))


def panel_incidents(s, d, window_days=1):
    return keep(("incidents", d, window_days), lambda: incidents.incidents(detection.mad_zscore(gold_table(s, d)), window_days=window_days))


_M = {m: m for m in incidents.RULE_METRICS}


def _piv():
    cols = ", ".join(f"max(CASE WHEN m = '{m}' THEN v END) AS {m}_v, max(CASE WHEN m = '{m}' THEN med END) AS {m}_b, "
                     f"max(CASE WHEN m = '{m}' THEN z END) AS {m}_z, coalesce(bool_or(CASE WHEN m = '{m}' THEN f END), false) AS {m}_f"
                     for m in incidents.RULE_METRICS)
    return f"w AS (SELECT d, {cols} FROM zz GROUP BY d)"


def _hi(m, g=3):
    return f"({m}_f AND coalesce({m}_z > {g}, false))"


def _lo(m, g=3):
    return f"({m}_f AND coalesce({m}_z < -{g}, false))"


def _lad(x, *steps):
    return "CASE " + " ".join(f"WHEN {x} > {b} THEN '{n}'" for b, n in steps) + " ELSE 'low' END"


_STD = ((6, "high"), (4, "medium"))


def _two(a, b):
    return f"CASE WHEN {_hi(b)} AND (NOT {_hi(a)} OR {b}_z > coalesce({a}_z, 0)) THEN '{b}' ELSE '{a}' END"


def _pz(p, a, b):
    return f"abs(CASE WHEN {p} = '{a}' THEN {a}_z ELSE {b}_z END)"


_F2, _S2, _P2 = (_two("delivery_delay_rate", "fulfillment_backlog"), _two("ticket_volume", "ticket_backlog"),
                 _two("supplier_delay_rate", "supplier_delay_severity"))
_MC = (f"CASE WHEN {_hi('expense_ratio')} AND (NOT {_lo('margin_proxy')} OR expense_ratio_z > coalesce(abs(margin_proxy_z), 0)) "
       "THEN 'expense_ratio' ELSE 'margin_proxy' END")
_LQ = f"CASE WHEN {_lo('net_cash_proxy')} THEN 'net_cash_proxy' ELSE 'ar_aging_amount' END"
_FALL = "coalesce(review_score_trend_v < -0.1, false)"
_SAT = (f"CASE WHEN {_FALL} AND (NOT {_lo('review_score_avg', 2.5)} OR abs(review_score_trend_v) > coalesce(abs(review_score_avg_v), 0)) "
        "THEN 'review_score_trend' ELSE 'review_score_avg' END")
_SZ = _pz(_S2, "ticket_volume", "ticket_backlog")
RULES_SQL = [
    ("refund_spike", _hi("refund_rate"), "'refund_rate'",
     f"CASE WHEN refund_rate_z > 8 AND refund_rate_v > .1 THEN 'critical' ELSE {_lad('refund_rate_z', *_STD)} END"),
    ("fulfillment_sla_degradation", f"{_hi('delivery_delay_rate')} OR {_hi('fulfillment_backlog')}", _F2,
     _lad(_pz(_F2, "delivery_delay_rate", "fulfillment_backlog"), *_STD)),
    ("support_load_surge", f"{_hi('ticket_volume')} OR {_hi('ticket_backlog')}", _S2,
     f"CASE WHEN {_hi('avg_resolution_time', 2)} AND {_SZ} > 4 THEN 'high' ELSE {_lad(_SZ, *_STD)} END"),
    ("churn_acceleration", _hi("churn_proxy", 2.5), "'churn_proxy'",
     f"CASE WHEN coalesce(customer_concentration_v > .5, false) AND churn_proxy_z > 4 THEN 'critical' ELSE {_lad('churn_proxy_z', (5, 'high'), (3.5, 'medium'))} END"),
    ("margin_compression", f"{_lo('margin_proxy')} OR {_hi('expense_ratio')}", _MC,
     _lad("greatest(coalesce(abs(margin_proxy_z), 0), coalesce(abs(expense_ratio_z), 0))", (6, "critical"), (4.5, "high"), (3.5, "medium"))),
    ("liquidity_crunch_risk", f"{_lo('net_cash_proxy')} OR {_hi('ar_aging_amount')}", _LQ,
     f"CASE WHEN {_lo('net_cash_proxy')} AND {_hi('ar_aging_amount')} THEN 'critical' ELSE {_lad(_pz(_LQ, 'net_cash_proxy', 'ar_aging_amount'), *_STD)} END"),
    ("supplier_dependency_failure", f"{_hi('supplier_delay_rate')} OR {_hi('supplier_delay_severity')}", _P2,
     _lad(_pz(_P2, "supplier_delay_rate", "supplier_delay_severity"), *_STD)),
    ("customer_satisfaction_regression", f"{_lo('review_score_avg', 2.5)} OR {_FALL}", _SAT,
     _lad(f"greatest(coalesce(abs(review_score_avg_z), 0), CASE WHEN {_FALL} THEN abs(review_score_trend_v) * 20 ELSE 0 END)", (5, "high"), (3.5, "medium"))),
]


def inc_sql(z=Z, gold=None):
    union = " UNION ALL ".join(
        f"SELECT d, '{k}' AS t, {i} AS o, {p} AS pm, {sev} AS sev FROM w WHERE {trig}" for i, (k, trig, p, sev) in enumerate(RULES_SQL))
    return (f"{gold or long_sql()}, {z}, {_piv()}, i0 AS ({union}), "
            "inc AS (SELECT i0.*, t || ':' || strftime(i0.d, '%Y-%m-%d') AS id, zz.v AS pv, zz.med AS pb, zz.z AS pz, zz.f AS pf, "
            "(i0.d + 1)::TIMESTAMP + to_seconds(o) AS det FROM i0 JOIN zz ON zz.d = i0.d AND zz.m = i0.pm)")


def inc_out(df):
    return r(r(df, "primary_value", "primary_baseline", "primary_zscore", digits=8).select(
        "incident_id", F.date_format("metric_date", "yyyy-MM-dd").alias("metric_date"), "incident_type", "severity",
        "confidence", F.concat_ws(",", "detection_methods").alias("detection_methods"), "primary_metric", "primary_value",
        "primary_baseline", "primary_zscore"))


INC_SELECT = """SELECT id AS incident_id, strftime(d, '%Y-%m-%d') AS metric_date, t AS incident_type, sev AS severity,
  CASE WHEN pf THEN 'medium' ELSE 'low' END AS confidence, 'mad_zscore' AS detection_methods, pm AS primary_metric,
  round(pv, 8) AS primary_value, round(pb, 8) AS primary_baseline, round(pz, 8) AS primary_zscore FROM inc"""
CUSTOMER_SIDE = ("support_load_surge", "churn_acceleration", "customer_satisfaction_regression")
CUSTOMER_METRICS = config.CUSTOMER


def customer_long(s, d):
    return daily.to_long(daily.gold_wide(star.support_panel_events(s, d)).select("metric_date", *CUSTOMER_METRICS), keep_nulls=True)


def customer_incidents(s, d):
    return incidents.incidents(detection.mad_zscore(customer_long(s, d)))


def customer_long_sql():
    union = " UNION ALL ".join(f"SELECT d, '{m}' AS m, {m}::DOUBLE AS v FROM wide" for m in CUSTOMER_METRICS)
    return f"{with_wide(SUPPORT)}, gold AS ({union})"


for n, (kind, *_rest) in enumerate(RULES_SQL, 1):
    source = customer_incidents if kind in CUSTOMER_SIDE else panel_incidents
    QUERIES[f"i{n}_{kind}"] = lambda s, d, kind=kind, source=source: inc_out(source(s, d).where(F.col("incident_type") == kind))
    SQL[f"i{n}_{kind}"] = f"WITH {inc_sql(gold=customer_long_sql() if kind in CUSTOMER_SIDE else None)} {INC_SELECT} WHERE t = '{kind}'"
QUERIES["i_all_incidents"] = lambda s, d: inc_out(panel_incidents(s, d))
SQL["i_all_incidents"] = f"WITH {inc_sql()} {INC_SELECT}"


def _fused(s, d):
    gold = money_long(s, d)
    z = detection.mad_zscore(gold)
    ml = detection.vote(detector_flags(s, d), ["metric_date"], 2)
    few = gold.where(F.col("metric_name").isin(CP_METRICS))
    cp = detection.break_flags(few, detection.changepoints(few), within=7)
    return inc_out(incidents.incidents(z, ml, cp))


QUERIES["i9_confidence"] = _fused
SQL["i9_confidence"] = f"""WITH RECURSIVE {inc_sql(gold=long_sql(MONEY, MONEY_METRICS))},
{_UNI}, {_FLAGS}, ml AS (SELECT d, sum(f::INT) >= 2 AS a FROM fl GROUP BY d),
{_DP.replace("FROM gold WHERE v IS NOT NULL", f"FROM gold WHERE v IS NOT NULL AND m IN ({', '.join(repr(m) for m in CP_METRICS)})")},
cp AS (SELECT s0.m, s0.d, len(list_filter(br, lambda b: b <= s0.i - 1 AND s0.i - 1 - b < 7)) > 0 AS c FROM s0 JOIN brk USING (m)),
x AS (SELECT inc.*, coalesce(a, false) AS a, coalesce(c, false) AS c FROM inc LEFT JOIN ml USING (d) LEFT JOIN cp ON cp.m = pm AND cp.d = inc.d)
SELECT id AS incident_id, strftime(d, '%Y-%m-%d') AS metric_date, t AS incident_type, sev AS severity,
  CASE WHEN NOT pf THEN 'low' WHEN a AND c THEN 'very_high' WHEN a OR c THEN 'high' ELSE 'medium' END AS confidence,
  'mad_zscore' || CASE WHEN a THEN ',isolation_forest' ELSE '' END || CASE WHEN c THEN ',changepoint' ELSE '' END AS detection_methods,
  pm AS primary_metric, round(pv, 8) AS primary_value, round(pb, 8) AS primary_baseline, round(pz, 8) AS primary_zscore FROM x"""

EV_MAP = "em(t, et) AS (VALUES " + ", ".join(
    f"('{k}', '{e}')" for k, v in config.EVIDENCE_EVENTS.items() for e in v) + ")"


def _evidence(s, d):
    inc, ev = panel_incidents(s, d), star.order_panel_events(s, d)
    rows = incidents.evidence_rows(inc, ev).groupBy("incident_id").agg(
        F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
    counts = incidents.evidence_counts(inc, ev)
    return counts.join(rows, "incident_id", "left")


QUERIES["i10_evidence"] = _evidence
SQL["i10_evidence"] = f"""WITH {inc_sql()}, {EV_MAP},
e AS (SELECT id, event_id FROM inc JOIN em USING (t) JOIN ev ON ev.event_type = et AND ev.d = inc.d)
SELECT inc.id AS incident_id, count(event_id) AS evidence_event_count, nullif(count(event_id), 0) AS n, min(event_id) AS first_id, max(event_id) AS last_id
FROM inc LEFT JOIN e USING (id) GROUP BY inc.id"""


def _supporting(s, d):
    inc = panel_incidents(s, d)
    return r(inc.select("incident_id", F.explode("supporting_metrics").alias("x")).select(
        "incident_id", F.col("x.metric").alias("metric"), F.col("x.value").alias("value"),
        F.col("x.baseline").alias("baseline"), F.round("x.zscore", 8).alias("zscore")), "value", "baseline", digits=8)


QUERIES["i11_supporting_metrics"] = _supporting
SQL["i11_supporting_metrics"] = f"""WITH {inc_sql()}, sup(t, m) AS (VALUES {", ".join(f"('{t}', '{m}')" for t, ms in [
    ('refund_spike', ['daily_refunds']), ('fulfillment_sla_degradation', ['delivery_delay_rate', 'fulfillment_backlog']),
    ('support_load_surge', ['ticket_volume', 'ticket_backlog', 'avg_resolution_time']),
    ('churn_acceleration', ['customer_concentration']), ('margin_compression', ['margin_proxy', 'expense_ratio']),
    ('liquidity_crunch_risk', ['net_cash_proxy', 'ar_aging_amount']),
    ('supplier_dependency_failure', ['supplier_delay_rate', 'supplier_delay_severity']),
    ('customer_satisfaction_regression', ['review_score_avg', 'review_score_trend'])] for m in ms)})
SELECT id AS incident_id, zz.m AS metric, round(zz.v, 8) AS value, round(zz.med, 8) AS baseline, round(zz.z, 8) AS zscore
FROM inc JOIN sup USING (t) JOIN zz ON zz.m = sup.m AND zz.d = inc.d WHERE sup.m <> pm"""

# --- cascades ------------------------------------------------------------------
LOOK = 7


def pairs(s, d):
    return keep(("pairs", d), lambda: _pairs(s, d))


def _pairs(s, d):
    return cascades.cascade_pairs_from_events(panel_incidents(s, d, LOOK), star.order_panel_events(s, d), types=panel_types(s, d))


PAIR_SQL = f"""{inc_sql()}, {EV_MAP}, ce(a, b) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in config.CASCADE_EDGES)}),
days AS (SELECT event_type, d, count(*) AS n FROM ev GROUP BY 1, 2),
evd AS (SELECT id, days.event_type, days.d, n FROM inc JOIN em USING (t) JOIN days ON days.event_type = et AND days.d BETWEEN inc.d - {LOOK - 1} AND inc.d),
sz AS (SELECT id, sum(n) AS n FROM evd GROUP BY id),
pr AS (SELECT a.id AS a_id, b.id AS b_id, round(exp(-epoch(b.det - a.det) / 86400.0 / 3), 4) AS tw FROM inc a JOIN ce ON ce.a = a.t JOIN inc b ON b.t = ce.b AND a.det < b.det
  WHERE exp(-epoch(b.det - a.det) / 86400.0 / 3) > .25),
sh AS (SELECT a_id, b_id, sum(x.n) AS n FROM pr JOIN evd x ON x.id = a_id JOIN evd y ON y.id = b_id AND x.event_type = y.event_type AND x.d = y.d GROUP BY 1, 2),
sc AS (SELECT a_id, b_id, tw, CASE WHEN coalesce(p.n, 0) = 0 OR coalesce(q.n, 0) = 0 THEN .1 ELSE round(coalesce(sh.n, 0)::DOUBLE / (p.n + q.n - coalesce(sh.n, 0)), 4) END::DOUBLE AS ov
  FROM pr LEFT JOIN sz p ON p.id = a_id LEFT JOIN sz q ON q.id = b_id LEFT JOIN sh USING (a_id, b_id)),
cp AS (SELECT *, round(tw * ov, 4) AS score FROM sc WHERE round(tw * ov, 4) >= .3)"""
QUERIES["c1_cascade_pairs"] = pairs
SQL["c1_cascade_pairs"] = f"WITH {PAIR_SQL} SELECT a_id, b_id, tw AS temporal_weight, ov AS overlap, score FROM cp"
QUERIES["c2_components"] = lambda s, d: cascades.components(pairs(s, d))
COMP_SQL = """ed AS (SELECT a_id AS u, b_id AS v FROM cp UNION SELECT b_id, a_id FROM cp),
reach AS (SELECT u AS n, u AS r FROM ed UNION SELECT reach.n, ed.v FROM reach JOIN ed ON ed.u = reach.r),
comp AS (SELECT n AS id, min(r) AS c FROM reach GROUP BY n)"""
SQL["c2_components"] = f"WITH RECURSIVE {PAIR_SQL}, {COMP_SQL} SELECT id AS incident_id, c AS component FROM comp"


def _order_links(s, d):
    """Chains of one customer's orders, in an order that has nothing to do with their ids."""
    o = star.table(s, d, "orders").select("o_orderkey", "o_custkey", F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("h"))
    after = F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("h"))
    return o.select(F.col("o_orderkey").alias("u"), after.alias("v")).where("v IS NOT NULL")


QUERIES["c2_components_orders"] = lambda s, d: graph.connected_components(_order_links(s, d), "u", "v")
SQL["c2_components_orders"] = """WITH RECURSIVE o AS (SELECT o_orderkey AS u, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY md5(o_orderkey::VARCHAR)) AS v FROM orders),
e AS (SELECT u, v FROM o WHERE v IS NOT NULL UNION SELECT v, u FROM o WHERE v IS NOT NULL), r AS (SELECT u AS n, u AS r FROM e UNION SELECT r.n, e.v FROM r JOIN e ON e.u = r.r)
SELECT n AS node, min(r) AS component FROM r GROUP BY n"""


def _summary(s, d):
    inc, ev = panel_incidents(s, d, LOOK), star.order_panel_events(s, d)
    comp = cascades.components(pairs(s, d))
    full = inc.join(incidents.evidence_counts(inc, ev, types=panel_types(s, d)), "incident_id")
    out = cascades.cascade_summary(full, comp)
    uniq = cascades.distinct_evidence(inc, ev, comp, types=panel_types(s, d)) \
        .withColumn("cascade_id", F.concat(F.lit("cascade:"), "component")).drop("component")
    return r(out.join(uniq, "cascade_id").drop("incident_ids").withColumn("cascade_path", F.concat_ws(">", "cascade_path")),
             "cascade_score")


QUERIES["c3_cascade_summary"] = _summary
SQL["c3_cascade_summary"] = f"""WITH RECURSIVE {PAIR_SQL}, {COMP_SQL},
x AS (SELECT inc.*, c, coalesce(sz.n, 0) AS n FROM inc JOIN comp USING (id) LEFT JOIN sz USING (id)),
ue AS (SELECT c, count(DISTINCT event_id) AS u FROM x JOIN em USING (t) JOIN ev ON ev.event_type = et AND ev.d BETWEEN x.d - {LOOK - 1} AND x.d GROUP BY c)
SELECT 'cascade:' || c AS cascade_id, arg_min(id, strftime(det, '%Y%m%d%H%M%S') || id) AS root_incident_id, count(*) AS total_incidents, CAST(sum(n) AS BIGINT) AS total_evidence_events,
  string_agg(t, '>' ORDER BY det, id) AS cascade_path, arg_max(sev, CASE sev WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END) AS max_severity,
  count(*) FILTER (sev = 'low') AS low_count, count(*) FILTER (sev = 'medium') AS medium_count, count(*) FILTER (sev = 'high') AS high_count,
  count(*) FILTER (sev = 'critical') AS critical_count, any_value(u) AS unique_evidence_entities,
  round(least(1, .7 * avg(CASE sev WHEN 'low' THEN .25::DOUBLE WHEN 'medium' THEN .5 WHEN 'high' THEN .75 ELSE 1 END) + .3 * least(count(*) - 1, 4) / 4.0), 4)::DOUBLE AS cascade_score
FROM x JOIN ue USING (c) GROUP BY c"""
QUERIES["c4_recurring_patterns"] = lambda s, d: cascades.recurring_patterns(panel_incidents(s, d), "2000-12-31", 1500)
SQL["c4_recurring_patterns"] = f"""WITH {inc_sql()}, x AS (SELECT t, month(det) AS m, quarter(det) AS q FROM inc WHERE det::DATE BETWEEN DATE '2000-12-31' - 1500 AND DATE '2000-12-31'),
mm AS (SELECT t, m AS p, count(*) AS c FROM x GROUP BY 1, 2), qq AS (SELECT t, q AS p, count(*) AS c FROM x GROUP BY 1, 2),
m1 AS (SELECT t, arg_max(p, c * 100 - p) AS m, max(c) AS mc, sum(c)::BIGINT AS n FROM mm GROUP BY t), q1 AS (SELECT t, arg_max(p, c * 100 - p) AS q, max(c) AS qc FROM qq GROUP BY t),
j AS (SELECT *, mc >= 2 AND mc * 100.0 / n >= 40 AS um, qc >= 2 AND qc * 100.0 / n >= 40 AS uq FROM m1 JOIN q1 USING (t) WHERE n >= 2)
SELECT t AS incident_type, CASE WHEN um THEN 'month' ELSE 'quarter' END AS period_kind, CAST(CASE WHEN um THEN m ELSE q END AS INTEGER) AS period,
  CASE WHEN um THEN mc ELSE qc END AS period_count, n AS occurrences, CASE WHEN CASE WHEN um THEN mc ELSE qc END * 100.0 / n >= 60 THEN 'high' ELSE 'medium' END AS confidence
FROM j WHERE um OR uq"""
QUERIES["c6_compare_significance"] = lambda s, d: r(cascades.compare_significance(_zpairs(s, d)).select(
    "a_id", "b_id", "z_statistic", "p_value", "significant", "effect_size"), "z_statistic", "p_value", "effect_size")


def _zpairs(s, d):
    inc = panel_incidents(s, d, LOOK).select("incident_id", "primary_zscore")
    p = pairs(s, d).select("a_id", "b_id")
    return p.join(inc.withColumnRenamed("incident_id", "a_id").withColumnRenamed("primary_zscore", "a_zscore"), "a_id") \
        .join(inc.withColumnRenamed("incident_id", "b_id").withColumnRenamed("primary_zscore", "b_zscore"), "b_id")
