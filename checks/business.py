"""Rankings, health, monitors, forecasts, finance and scenarios."""

from pyspark.sql import functions as F

from checks.detect import MONEY_METRICS, inc_sql, long_panel, long_sql, money_long, panel_incidents, r, text_date
from checks.views import MONEY, ORDER
from panelwise import config
from panelwise.operators import forecast, health, monitors, ranking
from panelwise.session import cut_lineage
from panelwise.sources import star

QUERIES, SQL = {}, {}
AS_OF = "2001-07-20"
D = f"DATE '{AS_OF}'"
LONG = long_sql()
MLONG = long_sql(MONEY, MONEY_METRICS)


def add(name, fn, sql):
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


def lst(c):
    return F.concat_ws(",", c)


add("k1_latest_by_metric", lambda s, d: text_date(ranking.latest_by_metric(long_panel(s, d), AS_OF)),
    f"WITH {LONG} SELECT m AS metric_name, arg_max(v, d) AS metric_value, strftime(max(d), '%Y-%m-%d') AS metric_date FROM gold WHERE v IS NOT NULL AND d BETWEEN {D} - 7 AND {D} GROUP BY m")


def receivables(s, d):
    ev = star.order_events(s, d)
    a = "attributes."
    x = ev.select("entity_id", F.element_at("related", F.lit("customer")).alias("customer"), "event_type", "event_time", "amount",
                  F.coalesce(a + "balance_remaining", a + "balance").alias("balance"), F.col(a + "days_overdue").alias("days_overdue"),
                  F.coalesce(a + "due_date", a + "original_due_date").alias("due_date"), F.col(a + "days_to_pay").alias("days_to_pay"))
    return forecast.receivable_risk(x, AS_OF, 365)


_RISK = f"""ev AS ({ORDER}), x AS (SELECT * FROM ev WHERE event_time >= {D} - 365 AND event_time <= {D} + 1),
ov AS (SELECT entity_id, customer, balance_remaining AS balance, days_overdue AS aging FROM x WHERE event_type = 'invoice_overdue'),
iss AS (SELECT entity_id, customer, balance, greatest(0, date_diff('day', due_date, {D}))::DOUBLE AS aging FROM x WHERE event_type = 'invoice_issued' AND balance > 0 AND entity_id NOT IN (SELECT entity_id FROM ov)),
pd AS (SELECT customer, avg(days_to_pay) AS dso, count(*) FILTER (days_to_pay > 30) AS late FROM x WHERE event_type = 'invoice_paid' GROUP BY 1),
op AS (SELECT o.*, coalesce(dso, 30) AS dso, coalesce(late, 0) AS late FROM (SELECT * FROM ov UNION ALL SELECT * FROM iss) o LEFT JOIN pd USING (customer) WHERE balance > 0),
rk AS (SELECT *, least(100, least(90, aging / 30 * 25) + least(30, log10(greatest(1, balance / 100)) * 10) + least(25, (dso - 30) / 30 * 15 + late * 5)) AS s FROM op)"""
_RISK_COLS = """entity_id, customer, balance, aging, round(dso, 4) AS dso, late, round(s, 5) AS risk_score, CASE WHEN s < 25 THEN 'low' WHEN s < 50 THEN 'medium' WHEN s < 75 THEN 'high' ELSE 'critical' END AS risk_bucket,
  coalesce(nullif(concat_ws(',', CASE WHEN aging > 30 THEN 'overdue' END, CASE WHEN balance > 5000 THEN 'high_balance' END, CASE WHEN dso > 45 THEN 'slow_payer' END, CASE WHEN late > 0 THEN 'late_history' END), ''), 'baseline') AS factors"""


def _risk_out(df):
    return r(r(df.withColumn("factors", lst("factors")), "dso"), "risk_score", digits=5)




def ordering():
    return [F.desc("risk_score"), F.desc("balance"), F.col("entity_id")]


add("f11_receivable_risk", lambda s, d: _risk_out(receivables(s, d)), f"WITH {_RISK} SELECT {_RISK_COLS} FROM rk")
add("k2_top_receivables", lambda s, d: _risk_out(ranking.top_n(receivables(s, d), ordering(), 25)),
    f"WITH {_RISK} SELECT {_RISK_COLS} FROM rk ORDER BY s DESC, balance DESC, entity_id LIMIT 25")
add("k3_page", lambda s, d: _risk_out(ranking.page(receivables(s, d), ordering(), 3, 20)),
    f"WITH {_RISK}, n AS (SELECT count(*) AS total FROM rk) SELECT {_RISK_COLS}, total FROM rk, n ORDER BY s DESC, balance DESC, entity_id LIMIT 20 OFFSET 40")
add("k4_metric_cards", lambda s, d: r(ranking.metric_cards(long_panel(s, d), AS_OF).withColumn("sparkline", lst(F.transform("sparkline", lambda x: F.round(x).cast("long").cast("string")))),
                                      "current_value", "previous_value", "change_percent"),
    f"""WITH {LONG}, g AS (SELECT m, d, v, row_number() OVER (PARTITION BY m ORDER BY d DESC) AS k FROM gold WHERE v IS NOT NULL AND d BETWEEN {D} - 30 AND {D}),
c AS (SELECT m, coalesce(arg_min(v, k) FILTER (v <> 0), 0) AS cur, arg_min(v, k) FILTER (v <> 0 AND k >= 2) AS prev0, string_agg(CAST(round(v) AS BIGINT)::VARCHAR, ',' ORDER BY k DESC) FILTER (k <= 10) AS sparkline FROM g GROUP BY m),
p AS (SELECT *, coalesce(prev0, cur) AS prev, coalesce((cur - coalesce(prev0, cur)) * 100 / nullif(coalesce(prev0, cur), 0), 0) AS ch FROM c)
SELECT m AS metric_name, round(cur, 4) AS current_value, round(prev, 4) AS previous_value, round(ch, 4) AS change_percent, CASE WHEN ch > 1 THEN 'up' WHEN ch < -1 THEN 'down' ELSE 'stable' END AS trend, sparkline FROM p""")


def _dedup(s, d):
    docs = star.table(s, d, "documents")
    x = docs.select("doc_id", F.col("text").alias("action"), "source", (F.col("n_chars") % 3).alias("priority"))
    return ranking.dedup_first(x, [F.substring("action", 1, 50), F.col("source")], [F.col("priority"), F.col("action"), F.col("doc_id")]).select("doc_id", "source", "priority")


add("k5_dedup_first", _dedup, """SELECT doc_id, source, n_chars % 3 AS priority FROM (SELECT *, row_number() OVER (PARTITION BY substr(text, 1, 50), source ORDER BY n_chars % 3, encode(text), doc_id) AS k FROM documents) WHERE k = 1""")
add("k6_timeseries", lambda s, d: text_date(ranking.timeseries(money_long(s, d), "refund_rate", AS_OF, 90)),
    f"WITH {MLONG} SELECT strftime(d, '%Y-%m-%d') AS metric_date, v AS metric_value FROM gold WHERE m = 'refund_rate' AND d BETWEEN {D} - 90 AND {D}")
add("j4_semi_anti", lambda s, d: ranking.in_set(star.table(s, d, "orders"), star.table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])
    .agg(F.count("*").alias("n")).withColumn("kind", F.lit("semi")).unionByName(
        ranking.not_in_set(star.table(s, d, "orders"), star.table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"]).agg(F.count("*").alias("n")).withColumn("kind", F.lit("anti"))),
    """SELECT 'semi' AS kind, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT 'anti', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")

# --- health -----------------------------------------------------------------------
_CFG = "cfg(dom, m, w, dir, good, bad) AS (VALUES " + ", ".join(
    f"('{a}', '{b}', {c}::DOUBLE, '{e}', {f}::DOUBLE, {g}::DOUBLE)" for a, b, c, e, f, g in config.HEALTH_METRICS) + ")"


def scored_sql(values):
    """values: relation with m, v and key columns."""
    return f"""{_CFG}, sc AS (SELECT x.*, dom, w, CASE WHEN dir = 'lower' AND v <= good OR dir = 'higher' AND v >= good THEN 1 WHEN dir = 'lower' AND v >= bad OR dir = 'higher' AND v <= bad THEN 0
  ELSE 1 / (1 + exp(-6 * ((v - bad) / (good - bad) - 0.5))) END::DOUBLE AS s FROM {values} x JOIN cfg USING (m))"""


def health_cols():
    dom = [f"coalesce(100 * sum(w * s) FILTER (dom = '{x}') / sum(w) FILTER (dom = '{x}'), 50)" for x in config.DOMAIN_WEIGHTS]
    overall = " + ".join(f"{e} * {w}::DOUBLE" for e, w in zip(dom, config.DOMAIN_WEIGHTS.values()))
    return ", ".join(f"round({e}, 4) AS {x}" for e, x in zip(dom, config.DOMAIN_WEIGHTS)), overall


_GR = "CASE WHEN {o} >= 90 THEN 'A' WHEN {o} >= 80 THEN 'B' WHEN {o} >= 70 THEN 'C' WHEN {o} >= 60 THEN 'D' ELSE 'F' END"
_LAST = f"lv AS (SELECT m, arg_max(v, d) AS v FROM gold WHERE v IS NOT NULL AND d BETWEEN {D} - 7 AND {D} GROUP BY m)"
_DOMS, _OVER = health_cols()
_HC = ["financial", "operational", "customer", "overall_score"]
add("h1_metric_scores", lambda s, d: r(health.metric_scores(ranking.latest_by_metric(long_panel(s, d), AS_OF)).drop("metric_date"), "score"),
    f"WITH {LONG}, {_LAST}, {scored_sql('lv')} SELECT m AS metric_name, v AS metric_value, dom AS domain, w AS weight, round(s, 4) AS score, CASE WHEN s >= .8 THEN 'healthy' WHEN s >= .5 THEN 'degraded' WHEN s >= .2 THEN 'warning' ELSE 'critical' END AS status FROM sc")
add("h2_health_score", lambda s, d: r(health.health_score(long_panel(s, d), AS_OF), *_HC),
    f"WITH {LONG}, {_LAST}, {scored_sql('lv')} SELECT {_DOMS}, round({_OVER}, 4) AS overall_score, {_GR.format(o=f'({_OVER})')} AS overall_grade FROM sc")
add("h3_health_trend", lambda s, d: r(health.health_trend(long_panel(s, d), AS_OF), "current_score", "previous_score", "delta"),
    f"""WITH {LONG}, pv AS (SELECT 'c' AS p, m, arg_max(v, d) AS v FROM gold WHERE v IS NOT NULL AND d BETWEEN {D} - 7 AND {D} GROUP BY m
UNION ALL SELECT 'p', m, arg_max(v, d) FROM gold WHERE v IS NOT NULL AND d BETWEEN {D} - 14 AND {D} - 7 GROUP BY m), {scored_sql('pv')},
o AS (SELECT p, {_OVER} AS o FROM sc GROUP BY p), w AS (SELECT max(o) FILTER (p = 'c') AS c, max(o) FILTER (p = 'p') AS q FROM o)
SELECT round(c, 4) AS current_score, round(q, 4) AS previous_score, round(c - q, 4) AS delta, CASE WHEN c - q > 2 THEN 'improving' WHEN c - q < -2 THEN 'degrading' ELSE 'stable' END AS trend FROM w""")
_DAILY = f"{LONG}, gv AS (SELECT * FROM gold WHERE v IS NOT NULL), {scored_sql('gv')}"
add("h4_daily_health", lambda s, d: r(text_date(health.daily_health(long_panel(s, d))), *_HC),
    f"WITH {_DAILY} SELECT strftime(d, '%Y-%m-%d') AS metric_date, {_DOMS}, round({_OVER}, 4) AS overall_score, {_GR.format(o=f'({_OVER})')} AS overall_grade FROM sc GROUP BY d")
add("h5_error_budget", lambda s, d: r(text_date(health.error_budget(health.daily_health(long_panel(s, d)), AS_OF, 90.0, 30, 60.0), "exhaustion_date"),
                                      "budget_minutes", "consumed_minutes", "remaining_pct", "burn_rate"),
    f"""WITH {_DAILY}, dh AS (SELECT d, {_OVER} AS o FROM sc GROUP BY d), u AS (SELECT count(*) AS days, count(*) FILTER (o < 60) AS b FROM dh WHERE d BETWEEN {D} - 30 AND {D}),
e AS (SELECT *, 4320.0::DOUBLE AS bud, b * 1440.0::DOUBLE AS con, greatest(0, (4320 - b * 1440.0) / 4320 * 100)::DOUBLE AS rem, (b * 1440.0 / (days / 30.0::DOUBLE * 4320))::DOUBLE AS burn FROM u)
SELECT days, b AS breached_days, bud AS budget_minutes, con AS consumed_minutes, round(rem, 4) AS remaining_pct, round(burn, 4) AS burn_rate,
  CASE WHEN burn > 1 AND rem > 0 THEN strftime({D} + CAST(floor((bud - con) / (con / days)) AS INTEGER), '%Y-%m-%d') END AS exhaustion_date,
  CASE WHEN rem <= 0 THEN 'exhausted' WHEN rem <= 25 OR burn > 2 THEN 'critical' WHEN rem <= 50 OR burn > 1.5 THEN 'warning' ELSE 'healthy' END AS status FROM e""")
add("h6_contributing_factors", lambda s, d: r(health.contributing_factors(health.metric_scores(ranking.latest_by_metric(long_panel(s, d), AS_OF))), "score"),
    f"""WITH {LONG}, {_LAST}, {scored_sql('lv')}, c AS (SELECT *, round((1 - s) * w * 100, 1) AS cp, CASE WHEN s < .6 THEN 'negative' WHEN s < .8 THEN 'neutral' ELSE 'positive' END AS dr FROM sc)
SELECT m AS metric_name, dom AS domain, v AS metric_value, round(s, 4) AS score, CASE WHEN s >= .8 THEN 'healthy' WHEN s >= .5 THEN 'degraded' WHEN s >= .2 THEN 'warning' ELSE 'critical' END AS status, cp AS contribution_pct, dr AS direction
FROM c ORDER BY CASE WHEN dr = 'negative' THEN -cp ELSE 0 END, s, m LIMIT 10""")

# --- monitors ------------------------------------------------------------------------
RULES = [("m1", "refund_rate", "value > baseline * 1.05", 30, "high"), ("m2", "margin_proxy", "value < baseline * 0.9", 14, "critical"),
         ("m3", "order_volume", "abs(value - baseline) > 2", 60, "medium"), ("m4", "fulfillment_backlog", "max(value, baseline) >= 1", 30, "low"),
         ("m5", "net_cash_proxy", "value < -0.1", 7, "high")]
_COND = {"m1": "val > base * 1.05", "m2": "val < base * 0.9", "m3": "abs(val - base) > 2", "m4": "greatest(val, base) >= 1", "m5": "val < -0.1"}


def _monitors(s, d):
    return monitors.evaluate_monitors(RULES, long_panel(s, d), AS_OF)


_MON = f"""{LONG}, ru(id, m, n, sev) AS (VALUES {", ".join(f"('{a}', '{b}', {n}, '{sv}')" for a, b, c, n, sv in RULES)}),
mv AS (SELECT id, m, sev, arg_max(v, d) AS val, avg(v) AS base, max(d) AS d FROM ru JOIN gold USING (m) WHERE v IS NOT NULL AND d BETWEEN {D} - n AND {D} GROUP BY 1, 2, 3),
mo AS (SELECT *, CASE id {" ".join(f"WHEN '{k}' THEN {v}" for k, v in _COND.items())} END AS fired FROM mv)"""
add("m1_evaluate_monitors", lambda s, d: r(text_date(_monitors(s, d)).drop("condition"), "value", "baseline"),
    f"WITH {_MON} SELECT id AS monitor_id, m AS metric_name, sev AS severity, round(val, 4) AS value, round(base, 4) AS baseline, strftime(d, '%Y-%m-%d') AS metric_date, fired AS triggered FROM mo")
add("m2_render_alerts", lambda s, d: monitors.render_alerts(_monitors(s, d).where("triggered"), "now {value}, usual {baseline}, x{multiplier}").select("monitor_id", "message"),
    f"WITH {_MON} SELECT id AS monitor_id, 'now ' || format('{{:,.4f}}', val) || ', usual ' || format('{{:,.4f}}', base) || ', x' || CASE WHEN base = 0 THEN 'inf' ELSE format('{{:,.2f}}', val / base) END AS message FROM mo WHERE fired")


def alerts(s, d):
    e = star.table(s, d, "events").where("event_type = 'error'")
    return e.select(F.col("event_id").alias("alert_id"), (F.col("user_id") % 25).alias("monitor_id"), F.col("ts").cast("timestamp").alias("triggered_at"),
                    F.expr("CASE event_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END").alias("severity"))


_SUP = """al AS (SELECT event_id AS id, user_id % 25 AS mon, ts, row_number() OVER (PARTITION BY user_id % 25 ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'error'),
fo AS (SELECT mon, k, id, ts AS last, false AS sup FROM al WHERE k = 1 UNION ALL
  SELECT al.mon, al.k, al.id, CASE WHEN al.ts - fo.last >= INTERVAL 4 HOUR THEN al.ts ELSE fo.last END, al.ts - fo.last < INTERVAL 4 HOUR FROM fo JOIN al ON al.mon = fo.mon AND al.k = fo.k + 1)"""
add("m3_suppress_alerts", lambda s, d: monitors.suppress(alerts(s, d)).select("alert_id", "monitor_id", "suppressed"),
    f"WITH RECURSIVE {_SUP} SELECT id AS alert_id, mon AS monitor_id, sup AS suppressed FROM fo")
add("m4_route_alerts", lambda s, d: monitors.route(alerts(s, d)).groupBy("severity", lst("channels").alias("channels"), "escalation_minutes").agg(F.count("*").alias("n")),
    """SELECT sev AS severity, ch AS channels, mi AS escalation_minutes, count(*) AS n FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS sev FROM events WHERE event_type = 'error')
JOIN (VALUES ('critical', 'pagerduty,slack_critical,email_oncall', 15), ('high', 'slack_alerts,email_oncall', 60), ('medium', 'slack_alerts', 240), ('low', 'slack_info', NULL)) t(sev, ch, mi) USING (sev) GROUP BY 1, 2, 3""")


def _log(s, d):
    e = star.table(s, d, "events")
    return e.select((F.col("event_id") % 997).alias("alert_id"), F.expr("CASE event_type WHEN 'click' THEN 'acknowledged' WHEN 'view' THEN 'dismissed' ELSE 'active' END").alias("status"),
                    F.col("ts").alias("changed_at"), F.when(F.col("event_type") == "purchase", F.concat(F.lit("inc"), "user_id")).alias("incident_id"))


add("m5_alert_state", lambda s, d: monitors.alert_state(_log(s, d)).select("alert_id", "status", "incident_id"),
    """SELECT event_id % 997 AS alert_id, arg_max(CASE event_type WHEN 'click' THEN 'acknowledged' WHEN 'view' THEN 'dismissed' ELSE 'active' END, ts) AS status, arg_max('inc' || user_id, ts) FILTER (event_type = 'purchase') AS incident_id FROM events GROUP BY 1""")
add("m5_active_alerts", lambda s, d: monitors.active_alerts(
    alerts(s, d).withColumn("alert_id", F.col("alert_id") % 1499), _log(s, d)).groupBy("severity", "severity_rank").agg(F.count("*").alias("n"), F.count("incident_id").alias("linked")),
    f"""WITH st AS ({SQL["m5_alert_state"]}), al AS (SELECT event_id % 1499 AS alert_id, CASE event_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity FROM events WHERE event_type = 'error')
SELECT severity, severity_rank, count(*) AS n, count(incident_id) AS linked FROM al LEFT JOIN st USING (alert_id) JOIN (VALUES {", ".join(f"('{k}', {v})" for k, v in config.SEVERITY_RANK.items())}) k(severity, severity_rank) USING (severity)
WHERE coalesce(status, 'active') = 'active' GROUP BY 1, 2""")
add("m6_recommended_monitors", lambda s, d: monitors.recommended_monitors(panel_incidents(s, d)).groupBy("metric_name", "condition", "frequency", "severity_if_triggered").agg(F.count("*").alias("n")),
    f"""WITH {inc_sql()}, rec(t, m, c, f) AS (VALUES {", ".join(f"('{k}', '{a}', '{b}', '{c}')" for k, v in monitors.RECOMMENDED.items() for a, b, c in v)})
SELECT m AS metric_name, c AS condition, f AS frequency, CASE WHEN sev IN ('high', 'critical') THEN 'high' ELSE 'medium' END AS severity_if_triggered, count(*) AS n FROM inc JOIN rec USING (t) GROUP BY 1, 2, 3, 4""")

# --- forecasts --------------------------------------------------------------------------
_FIT = f"""tx AS (SELECT m, d, v, row_number() OVER (PARTITION BY m ORDER BY d) - 1 AS x FROM gold WHERE v IS NOT NULL AND d BETWEEN {D} - 14 AND {D}),
ft0 AS (SELECT m, count(*) AS n, regr_slope(v, x) AS b, regr_intercept(v, x) AS a, regr_r2(v, x) AS r2, regr_sxx(v, x) AS sxx, regr_syy(v, x) AS syy, arg_max(v, d) AS cur, arg_min(v, d) AS fst FROM tx GROUP BY m HAVING count(*) = 15),
ft1 AS (SELECT *, sqrt(greatest(0, 1 - r2) * syy / 13 / sxx) AS se FROM ft0), ft2 AS (SELECT *, atan(abs(b / se) / sqrt(13)) AS th FROM ft1),
ft AS (SELECT *, CASE WHEN syy = 0 THEN 1 WHEN se = 0 THEN 0 ELSE greatest(0, 1 - 2 / pi() * (th + sin(th) * (cos(th) + 2/3.0::DOUBLE * cos(th)^3 + 8/15.0::DOUBLE * cos(th)^5 + 48/105.0::DOUBLE * cos(th)^7 + 384/945.0::DOUBLE * cos(th)^9 + 3840/10395.0::DOUBLE * cos(th)^11))) END AS p,
  b * 19 + a AS proj FROM ft2)"""


def _fit(s, d):
    return forecast.trend_fit(long_panel(s, d), AS_OF)


add("f1_trend_fit", lambda s, d: r(_fit(s, d).select("metric_name", "n", "slope", "current_value", "projected_value", "projected_lower", "projected_upper", "p_value", "baseline"),
                                   "slope", "current_value", "projected_value", "projected_lower", "projected_upper", "p_value", "baseline", digits=5),
    f"""WITH {LONG}, {_FIT} SELECT m AS metric_name, n, round(b, 5) AS slope, round(cur, 5) AS current_value, round(proj, 5) AS projected_value, round(proj - 1.96 * se * sqrt(1 + 1.0 / 15 + 144 / sxx), 5) AS projected_lower,
  round(proj + 1.96 * se * sqrt(1 + 1.0 / 15 + 144 / sxx), 5) AS projected_upper, round(p, 5) AS p_value, round((cur + fst) / 2, 5) AS baseline FROM ft""")


def warnings(s, d, as_of=AS_OF):
    return forecast.warning_severity(forecast.trend_warnings(long_panel(s, d), as_of, max_p=0.9, min_slope=0.0001))


_WARN = f"""{LONG}, {_FIT}, th(m, lim, below) AS (VALUES {", ".join(f"('{a}', {b}, {c})" for a, b, c in forecast.TREND_THRESHOLDS)}),
wn AS (SELECT *, (lim - cur) / b AS dtt FROM ft JOIN th USING (m) WHERE p < .9 AND abs(b) >= .0001 AND CASE WHEN below THEN b < 0 AND proj < lim AND cur > lim ELSE b > 0 AND proj > lim AND cur < lim END)"""
add("f2_warning_severity", lambda s, d: r(warnings(s, d).select("metric_name", "days_to_threshold", "severity", "threshold"), "days_to_threshold"),
    f"WITH {_WARN} SELECT m AS metric_name, round(dtt, 4) AS days_to_threshold, CASE WHEN dtt <= 2 THEN 'critical' WHEN dtt <= 5 THEN 'high' WHEN dtt <= 10 THEN 'medium' ELSE 'low' END AS severity, lim::DOUBLE AS threshold FROM wn")
_LAGS = [f"lag_{i}" for i in range(14)]
_LC = [*_LAGS, "mean_7", "std_7", "mean_14", "std_14", "diff_1", "target"]
add("f3_lag_features", lambda s, d: r(text_date(forecast.lag_features(money_long(s, d).where(F.col("metric_name").isin("refund_rate", "margin_proxy")))), *_LC, digits=8),
    f"""WITH {MLONG}, x AS (SELECT m AS metric_name, d, {", ".join(f"lag(v, {i}) OVER w AS lag_{i}" if i else "v AS lag_0" for i in range(14))}, avg(v) OVER (w ROWS 6 PRECEDING) AS mean_7, stddev_samp(v) OVER (w ROWS 6 PRECEDING) AS std_7,
  avg(v) OVER (w ROWS 13 PRECEDING) AS mean_14, stddev_samp(v) OVER (w ROWS 13 PRECEDING) AS std_14, v - lag(v) OVER w AS diff_1, lead(v, 5) OVER w AS target FROM gold WHERE m IN ('refund_rate', 'margin_proxy') WINDOW w AS (PARTITION BY m ORDER BY d))
SELECT metric_name, strftime(d, '%Y-%m-%d') AS metric_date, {", ".join(f"round({c}, 8) AS {c}" for c in _LC)} FROM x WHERE lag_13 IS NOT NULL""")
_G9 = "['A', 'B+', 'B', 'B-', 'C+', 'C', 'C-', 'D', 'F']"
add("f5_future_score", lambda s, d: r(forecast.future_score(health.health_score(long_panel(s, d), AS_OF), warnings(s, d)), "overall_score", "projected_score"),
    f"""WITH {_WARN}, {_LAST}, {scored_sql('lv')}, h AS (SELECT {_OVER} AS o, {_GR.format(o=f'({_OVER})')} AS g FROM sc),
w AS (SELECT arg_min(m, dtt) AS tm, min(dtt) AS dt, count(*) AS n FROM wn), x AS (SELECT *, CASE WHEN n = 0 THEN NULL WHEN dt <= 2 THEN 'critical' WHEN dt <= 5 THEN 'high' WHEN dt <= 10 THEN 'medium' ELSE 'low' END AS sev FROM h, w)
SELECT round(o, 4) AS overall_score, g AS overall_grade, round(greatest(0, o - CASE WHEN sev = 'critical' THEN 15 WHEN sev IS NOT NULL THEN 10 ELSE 0 END), 4) AS projected_score,
  CASE WHEN sev IS NULL OR sev = 'low' THEN g ELSE {_G9}[least(9, list_position(list_transform({_G9}, lambda t: t[1]), g) + CASE WHEN sev = 'critical' THEN 2 ELSE 1 END)] END AS projected_grade, tm AS top_metric, sev AS top_severity, n AS warnings_count FROM x""")

_RUN = f"""dd AS (SELECT d, coalesce(max(v) FILTER (m = 'daily_expenses'), 0) - coalesce(max(v) FILTER (m = 'daily_revenue'), 0) AS burn, coalesce(max(v) FILTER (m = 'net_cash_proxy'), 0) AS cash FROM gold WHERE d BETWEEN {D} - 60 AND {D} GROUP BY d),
ru0 AS (SELECT avg(burn) AS mb, stddev_pop(burn) AS sd, count(*) AS n, arg_max(cash, d) AS cash FROM dd),
ru AS (SELECT n, 5e7 + cash AS cash, 1e6 + mb * 30 AS burn, 1e6 + (mb - 2.000297821058262 * sd / sqrt(61)) * 30 AS lo, 1e6 + (mb + 2.000297821058262 * sd / sqrt(61)) * 30 AS hi FROM ru0),
rw AS (SELECT *, CASE WHEN burn > 0 AND cash > 0 THEN cash / burn END AS mo, CASE WHEN burn > 0 AND cash > 0 AND hi > 0 THEN cash / hi END AS ml, CASE WHEN burn > 0 AND cash > 0 AND lo > 0 THEN cash / lo END AS mh FROM ru)"""


def burning(s, d):
    """The money panel with a fixed daily cost and opening cash added, so that the burn is positive."""
    v = F.col("metric_value")
    return money_long(s, d).withColumn("metric_value", F.when(F.col("metric_name") == "daily_expenses", v + 1e6 / 30)
                                       .when(F.col("metric_name") == "net_cash_proxy", v + 5e7).otherwise(v))


def runway(s, d):
    return forecast.cash_runway(burning(s, d), AS_OF)


_RC = ["net_cash", "monthly_burn", "burn_low", "burn_high", "runway_months", "runway_lower", "runway_upper"]
add("f6_cash_runway", lambda s, d: r(runway(s, d), *_RC, digits=3),
    f"""WITH {MLONG}, {_RUN} SELECT round(cash, 3) AS net_cash, round(burn, 3) AS monthly_burn, round(lo, 3) AS burn_low, round(hi, 3) AS burn_high, n AS data_points, burn <= 0 AS runway_infinite,
  round(mo, 3) AS runway_months, round(ml, 3) AS runway_lower, round(mh, 3) AS runway_upper FROM rw""")
add("f7_cash_curve", lambda s, d: r(text_date(forecast.cash_curve(runway(s, d), AS_OF), "month"), "cash_baseline", "cash_best", "cash_worst", digits=2),
    f"""WITH {MLONG}, {_RUN}, b AS (SELECT *, CASE WHEN ml IS NOT NULL AND mh IS NOT NULL THEN lo ELSE burn * .8 END AS bl, CASE WHEN ml IS NOT NULL AND mh IS NOT NULL THEN hi ELSE burn * 1.2 END AS bh FROM rw)
SELECT strftime(date_trunc('month', {D}) + to_months(CAST(i AS INTEGER)), '%Y-%m-%d') AS month, round(greatest(0, cash - burn * i), 2) AS cash_baseline, round(greatest(0, cash - bl * i), 2) AS cash_best, round(greatest(0, cash - bh * i), 2) AS cash_worst FROM b, range(7) t(i)""")
add("f8_expense_scenarios", lambda s, d: r(forecast.expense_scenarios(runway(s, d), [5, 10, 25, 50]), "burn_before", "burn_after", "runway_months", "scenario_months", "improvement_months", digits=3),
    f"""WITH {MLONG}, {_RUN}, s AS (SELECT *, c::DOUBLE AS c2, burn * (1 - .7 * c / 100.0::DOUBLE) AS af FROM rw, (VALUES (5), (10), (25), (50)) t(c)), z AS (SELECT *, CASE WHEN af > 0 AND cash > 0 THEN cash / af END AS sm FROM s)
SELECT c2 AS expense_cut_pct, round(burn, 3) AS burn_before, round(af, 3) AS burn_after, round(mo, 3) AS runway_months, round(sm, 3) AS scenario_months, af <= 0 AS infinite_after, round(sm - coalesce(mo, 0), 3) AS improvement_months FROM z""")
add("f9_collection_scenarios", lambda s, d: r(forecast.collection_scenarios(runway(s, d), receivables(s, d), [5, 20, 50]), "collected", "new_cash", "scenario_months", "improvement_months", digits=3),
    f"""WITH {MLONG}, {_RUN}, {_RISK.replace("ev AS (", "ev2 AS (", 1).replace("FROM ev WHERE", "FROM ev2 WHERE", 1)}, q AS (SELECT balance, row_number() OVER (ORDER BY s DESC, balance DESC, entity_id) AS k FROM rk),
c AS (SELECT t.n AS top_n, sum(balance) AS amt FROM (VALUES (5), (20), (50)) t(n) JOIN q ON k <= t.n GROUP BY 1), z AS (SELECT *, CASE WHEN burn > 0 AND cash + amt > 0 THEN (cash + amt) / burn END AS sm FROM c, rw)
SELECT CAST(top_n AS INTEGER) AS top_n, round(amt, 3) AS collected, round(cash + amt, 3) AS new_cash, round(sm, 3) AS scenario_months, burn <= 0 AS infinite_after, round(sm - coalesce(mo, 0), 3) AS improvement_months FROM z""")
add("f10_tax_estimate", lambda s, d: r(forecast.tax_estimate(money_long(s, d), AS_OF).withColumn("audit_factors", lst("audit_factors")), "revenue", "expenses", "refunds", "taxable_income", "estimated_tax", digits=2),
    f"""WITH {MLONG}, y AS (SELECT d, max(v) FILTER (m = 'daily_revenue') AS rev, max(v) FILTER (m = 'daily_expenses') AS ex, max(v) FILTER (m = 'daily_refunds') AS rf, max(v) FILTER (m = 'margin_proxy') AS mg, row_number() OVER (ORDER BY d DESC) AS k FROM gold WHERE v IS NOT NULL AND d BETWEEN {D} - 365 AND {D} GROUP BY d),
t AS (SELECT sum(rev) AS a, sum(ex) AS b, sum(rf) AS c, avg(mg) AS mg, count(*) AS n, sum(rev) FILTER (k <= 7) AS r7, sum(ex) FILTER (k <= 7) AS e7, sum(rev) FILTER (k BETWEEN 8 AND 14) AS p7 FROM y),
u AS (SELECT *, a - b - c AS inc, concat_ws(',', CASE WHEN n < 7 THEN 'limited_history' END, CASE WHEN e7 / nullif(r7, 0) >= .95 THEN 'high_expense_ratio' END, CASE WHEN mg < .05 AND a > 10000 THEN 'low_margin' END, CASE WHEN n >= 14 AND r7 / nullif(p7, 0) >= 2 THEN 'revenue_spike' END) AS fa FROM t)
SELECT round(a, 2) AS revenue, round(b, 2) AS expenses, round(c, 2) AS refunds, round(inc, 2) AS taxable_income, round(CASE WHEN inc > 0 THEN inc * .25 ELSE 0 END, 2) AS estimated_tax, n AS days_with_data, fa AS audit_factors,
  CASE WHEN fa = '' THEN 'low' WHEN fa LIKE '%,%' THEN 'high' ELSE 'elevated' END AS audit_risk FROM u""")


def _periods(unit):
    back = 3 if unit == "quarter" else 1
    return f"""pp AS (SELECT m, avg(v) FILTER (d >= date_trunc('{unit}', {D})) AS c, avg(v) FILTER (d < date_trunc('{unit}', {D})) AS p FROM gold WHERE v IS NOT NULL AND d >= date_trunc('{unit}', {D}) - INTERVAL {back} MONTH AND d <= {D} GROUP BY m)"""


add("f12_period_compare", lambda s, d: r(forecast.period_compare(long_panel(s, d), AS_OF, "quarter"), "current", "previous", "change_pct"),
    f"""WITH {LONG}, {_periods('quarter')}, q AS (SELECT *, (c - p) * 100 / nullif(abs(p), 0) AS ch FROM pp) SELECT m AS metric_name, round(c, 4) AS current, round(p, 4) AS previous, round(ch, 4) AS change_pct,
  CASE WHEN m IN ('daily_revenue', 'margin_proxy', 'order_volume', 'review_score_avg', 'net_cash_proxy') THEN ch > 0 ELSE ch < 0 END AS improved FROM q""")


def _sh(v):
    return f"""CASE WHEN m = 'refund_rate' THEN greatest(0, 100 - {v} * 500) WHEN m IN ('expense_ratio', 'churn_proxy') THEN greatest(0, 100 - {v} * 200) WHEN m = 'dso_proxy' THEN greatest(0, 100 - {v})
  WHEN m = 'delivery_delay_rate' THEN greatest(0, 100 - {v} * 250) WHEN m = 'ticket_backlog' THEN greatest(0, 100 - {v} / 2) WHEN m IN ('margin_proxy', 'review_score_avg') THEN least(100, {v} * 25)
  WHEN m IN ('daily_revenue', 'net_cash_proxy') THEN least(100, greatest(0, {v} / 500)) ELSE 50 END"""


add("f12_period_summary", lambda s, d: r(forecast.period_summary(long_panel(s, d), panel_incidents(s, d), AS_OF, "month"), "health", "previous_health", "health_change_pct"),
    f"""WITH {inc_sql()}, {_periods('month')}, hh AS (SELECT avg({_sh('c')}) FILTER (c IS NOT NULL) AS hc, avg({_sh('p')}) FILTER (p IS NOT NULL) AS hp FROM pp),
nn AS (SELECT count(*) FILTER (det::DATE >= date_trunc('month', {D})) AS a, count(*) FILTER (det::DATE < date_trunc('month', {D})) AS b FROM inc WHERE det::DATE >= date_trunc('month', {D}) - INTERVAL 1 MONTH AND det::DATE <= {D})
SELECT round(hc, 4) AS health, round(hp, 4) AS previous_health, a AS incidents, b AS previous_incidents, round((hc - hp) * 100 / hp, 4) AS health_change_pct, CASE WHEN (hc - hp) * 100 / hp > 1 THEN 'up' WHEN (hc - hp) * 100 / hp < -1 THEN 'down' ELSE 'flat' END AS trend FROM hh, nn""")

# --- scenarios ---------------------------------------------------------------------------
def scenarios(s, d):
    """One scenario per supplier: its balance decides which metric moves and by how much."""
    x = star.table(s, d, "supplier")
    return x.select(F.col("s_suppkey").alias("scenario"), F.expr("CASE s_suppkey % 3 WHEN 0 THEN 'supplier_delay_rate' WHEN 1 THEN 'fulfillment_backlog' ELSE 'expense_ratio' END").alias("metric_name"),
                    (F.col("s_acctbal") / 50).alias("change_pct"))


def base(s, d):
    """At most 27 rows, read several times by one scenario plan: materialised once."""
    return cut_lineage(ranking.latest_by_metric(long_panel(s, d), AS_OF).select("metric_name", "metric_value"))


def _full(s, d):
    b = base(s, d)
    return forecast.full_scenario(forecast.propagate(scenarios(s, d), b), b)


def _hop(prev, out, depth):
    # one hop: sources not yet expanded, later sources (by name) win, existing rows are overwritten
    return f"""e{depth} AS (SELECT sc, dst, arg_max(ch, src) AS ch FROM (SELECT sc, m AS src, dst, (val - bs) / bs * corr * {0.7 ** depth!r} AS ch FROM {prev} JOIN ed USING (m) WHERE NOT done AND bs <> 0) JOIN lv ON lv.m = dst WHERE abs(ch) > .01 GROUP BY sc, dst),
{out} AS (SELECT coalesce(a.sc, n.sc) AS sc, coalesce(a.m, n.dst) AS m, coalesce(a.bs, lv.v) AS bs, coalesce(lv.v * (1 + n.ch), a.val) AS val, coalesce(a.depth, {depth}) AS depth, a.sc IS NOT NULL AS done
  FROM {prev} a FULL JOIN e{depth} n ON a.sc = n.sc AND a.m = n.dst LEFT JOIN lv ON lv.m = n.dst)"""


_SCN = f"""{LONG}, {_LAST}, ed(m, dst, corr) AS (VALUES {", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in config.SCENARIO_EDGES)}),
sn AS (SELECT s_suppkey AS sc, CASE s_suppkey % 3 WHEN 0 THEN 'supplier_delay_rate' WHEN 1 THEN 'fulfillment_backlog' ELSE 'expense_ratio' END AS m, s_acctbal / 50 AS pct FROM supplier),
p0 AS (SELECT sc, m, v AS bs, v * (1 + pct / 100) AS val, 0 AS depth, abs(v * pct / 100) <= 1e-6 AS done FROM sn JOIN lv USING (m)),
{_hop('p0', 'p1', 1)}, {_hop('p1', 'p2', 2)}, {_hop('p2', 'p3', 3)}"""
add("f13_propagate", lambda s, d: r(forecast.propagate(scenarios(s, d), base(s, d)), "base", "simulated"),
    f"WITH {_SCN} SELECT sc AS scenario, m AS metric_name, round(bs, 4) AS base, round(val, 4) AS simulated, CAST(depth AS INTEGER) AS depth FROM p3")
_FULLSQL = f"""{_SCN}, fs AS (SELECT q.sc, lv.m, lv.v AS bs, coalesce(p3.val, lv.v) AS val FROM (SELECT DISTINCT sc FROM p3) q CROSS JOIN lv LEFT JOIN p3 ON p3.sc = q.sc AND p3.m = lv.m),
th(t, m, lim, below, sev) AS (VALUES {", ".join(f"('{a}', '{b}', {c}, {e}, '{f}')" for a, b, c, e, f in forecast.SCENARIO_THRESHOLDS)}),
tr AS (SELECT sc, t, m, sev, val, lim FROM fs JOIN th USING (m) WHERE CASE WHEN below THEN val < lim ELSE val > lim END)"""
add("f14_scenario_incidents", lambda s, d: r(forecast.scenario_incidents(_full(s, d)).select("scenario", "incident_type", "metric_name", "severity", "simulated"), "simulated"),
    f"WITH {_FULLSQL} SELECT sc AS scenario, t AS incident_type, m AS metric_name, sev AS severity, round(val, 4) AS simulated FROM tr")
add("f14_scenario_cascades", lambda s, d: forecast.scenario_cascades(forecast.scenario_incidents(_full(s, d))),
    f"WITH {_FULLSQL} SELECT a.sc AS scenario, a.t || ' -> ' || b.t AS cascade FROM tr a JOIN tr b ON a.sc = b.sc JOIN (VALUES {', '.join(f'({a!r}, {b!r})' for a, b in forecast.SCENARIO_CASCADES)}) c(x, y) ON a.t = c.x AND b.t = c.y")
add("f15_scenario_health", lambda s, d: r(forecast.scenario_health(_full(s, d), health.health_score(long_panel(s, d), AS_OF).select("overall_score")), "degradation", "current_score", "projected_score"),
    f"""WITH {_FULLSQL}, {scored_sql('lv')}, h AS (SELECT {_OVER} AS o FROM sc),
g AS (SELECT fs.sc, sum(CASE WHEN m IN ('refund_rate', 'delivery_delay_rate', 'churn_proxy') AND bs > 0 AND val > bs THEN least(20, (val - bs) / bs * 30) WHEN m IN ('margin_proxy', 'review_score_avg') AND bs > 0 AND val < bs THEN least(15, (bs - val) / bs * 25) ELSE 0 END) AS dg FROM fs GROUP BY fs.sc),
z AS (SELECT *, greatest(0, least(100, o - dg)) AS pr FROM g, h) SELECT sc AS scenario, round(dg, 4) AS degradation, round(o, 4) AS current_score, round(pr, 4) AS projected_score, {_GR.format(o='pr')} AS projected_grade FROM z""")
