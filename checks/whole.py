"""Detection, incidents, cascades and health over all 27 metrics of the whole panel: orders, ledger, shipments, churn, tickets, reviews."""

from pyspark.sql import functions as F

from checks import detect
from checks.business import AS_OF, D, _GR, _HC, health_cols, scored_sql
from checks.detect import Z, inc_out, inc_sql, r, text_date
from checks.shared import keep
from checks.views import WHOLE, with_wide
from panelwise import config
from panelwise.operators import cascades, daily, detection, health, incidents, ordering, ranking
from panelwise.sources import star

QUERIES, SQL = {}, {}


def add(name, fn, sql):
    QUERIES[name] = fn
    SQL[name] = sql


# --- the panel: built from both event families, written once per query ------------------------
def wide(s, d):
    return keep(("whole wide", d), lambda: daily.gold_wide(star.whole_panel_events(s, d, linked=True), types=types(s, d)))


def types(s, d):
    """Daily sums per event type: events are read once for everything daily."""
    return keep(("whole type days", d), lambda: daily.type_days(star.whole_panel_events(s, d)))


def gold(s, d):
    return daily.to_long(wide(s, d), keep_nulls=True)


_WIDE = with_wide(WHOLE)
_GOLD = f"{_WIDE}, gold AS (" + " UNION ALL ".join(f"SELECT d, '{m}' AS m, {m}::DOUBLE AS v FROM wide" for m in config.METRICS) + ")"

# --- detectors --------------------------------------------------------------------------------
add("d1a_whole_mad_zscore_joined", lambda s, d: detect._z_out(detection.mad_zscore_joined(gold(s, d))), f"WITH {_GOLD}, {Z} {detect._Z_SELECT}")


def breaks(s, d):
    return keep(("whole breaks", d), lambda: detection.changepoints(gold(s, d), grid=1 / 1048576))


_COST = "costs[a + 1] + (qq[j + 1] - qq[a + 1]) - (ss[j + 1] - ss[a + 1]) ** 2 / (ii[j + 1] - ii[a + 1]) + ln(n)"
_DP = detect._DP.replace(_COST, f"round(({_COST}) * 1048576) / 1048576")


add("d3_whole_changepoints",
    lambda s, d: breaks(s, d).select("metric_name", "n", F.concat_ws(",", F.transform("breaks", lambda b: b.cast("string"))).alias("breaks")),
    f"WITH RECURSIVE {_GOLD}, {_DP} SELECT m AS metric_name, n, array_to_string(br, ',') AS breaks FROM brk")
add("d4_whole_regime_change",
    lambda s, d: r(text_date(detection.regime_change(gold(s, d), breaks(s, d)), "change_date").withColumn("change_index", F.col("change_index").cast("long")),
                   "before_mean", "after_mean", "mean_shift", "percent_change", digits=3),
    f"WITH RECURSIVE {_GOLD}, {_DP}," + detect.SQL["d4_regime_change"].partition(f"{detect._DP},")[2])
_TEMPORAL = ("metric_value", "mean_7", "std_14", "wow_delta")


def _short(df):
    """Three digits; a shift keeps sixth digits off the tie of the rounding, and there are no negative zeros."""
    short = df.select("metric_name", "metric_date", *[F.round(F.col(c) + 1e-7, 3).alias(c) for c in _TEMPORAL])
    return short.select("metric_name", "metric_date", *[F.when(F.col(c) == 0, 0.0).otherwise(F.col(c)).alias(c) for c in _TEMPORAL])


add("d5_whole_temporal_features",
    lambda s, d: _short(text_date(detection.temporal_features(gold(s, d)))),
    f"WITH {_GOLD}, o AS (SELECT" + detect.SQL["d5_temporal_features"].partition("\nSELECT")[2].replace(", 3)", " + 1e-7, 3)")
    + ") SELECT metric_name, metric_date, " + ", ".join(f"CASE WHEN {c} = 0 THEN 0 ELSE {c} END::DOUBLE AS {c}" for c in _TEMPORAL) + " FROM o")


def univariate(s, d):
    return detection.univariate_features(wide(s, d), config.METRICS)


_UNI = f"u0 AS (SELECT d, coalesce(list_avg([{', '.join(f'{m}::DOUBLE' for m in config.METRICS)}]), 0) AS x FROM wide)," + detect._UNI.partition("FROM rolled),")[2]
_LABELS = "q AS (SELECT quantile_cont(abs(deviation), .98) AS c FROM u)"
add("d6_whole_univariate_features", lambda s, d: r(text_date(univariate(s, d)), *detect._UCOLS, digits=5),
    f"WITH {_WIDE}, {_UNI} SELECT strftime(d, '%Y-%m-%d') AS metric_date, " + ", ".join(f"round({c}, 5) AS {c}" for c in detect._UCOLS) + " FROM u")


def flags(s, d):
    return detect.flags_of(univariate(s, d))


def pseudo(s, d):
    return ordering.pseudo_labels(univariate(s, d).select("metric_date", F.abs("deviation").alias("score")), "score", 0.02)


add("d10_whole_vote",
    lambda s, d: r(text_date(detection.vote(flags(s, d), ["metric_date"], 2, {"level": 0.5, "deviation": 0.3, "jump": 0.2})), "weighted_score"),
    f"WITH {_WIDE}, {_UNI}, {detect._FLAGS}" + detect.SQL["d10_vote"].partition(detect._FLAGS)[2])
add("d10_whole_detector_weights",
    lambda s, d: r(detection.detector_weights(flags(s, d), pseudo(s, d).select("metric_date", "label"), ["metric_date"]), "f1", "weight"),
    f"WITH {_WIDE}, {_UNI}, {detect._FLAGS}" + detect.SQL["d10_detector_weights"].partition(detect._FLAGS)[2])
add("d11_whole_pseudo_labels", lambda s, d: r(text_date(pseudo(s, d)), "score", digits=5),
    f"WITH {_WIDE}, {_UNI}, {_LABELS} SELECT strftime(d, '%Y-%m-%d') AS metric_date, round(abs(deviation), 5) AS score, abs(deviation) >= c AS label FROM u, q")


# --- incidents: all eight rules, confidence from all metrics ------------------------------------
def found(s, d, window_days=1):
    return keep(("whole incidents", d, window_days), lambda: incidents.incidents(detection.mad_zscore(gold(s, d)), window_days=window_days))


_INC = inc_sql(gold=_GOLD)
add("i_whole_incidents", lambda s, d: inc_out(found(s, d)), f"WITH {_INC} {detect.INC_SELECT}")


def fused(s, d):
    panel = gold(s, d)
    votes = detection.vote(flags(s, d), ["metric_date"], 2)
    return inc_out(incidents.incidents(detection.mad_zscore(panel), votes, detection.break_flags(panel, breaks(s, d), within=7)))


add("i9_whole_confidence", fused,
    f"WITH RECURSIVE {_INC}, {_UNI}, {detect._FLAGS}, ml AS (SELECT d, sum(f::INT) >= 2 AS a FROM fl GROUP BY d), {_DP},"
    + "\ncp AS" + detect.SQL["i9_confidence"].partition("\ncp AS")[2])
add("i10_whole_evidence_counts", lambda s, d: incidents.evidence_counts(found(s, d, 3), star.whole_panel_events(s, d), types=types(s, d)),
    f"""WITH {_INC}, {detect.EV_MAP}, days AS (SELECT event_type, d, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT id AS incident_id, coalesce(sum(n), 0)::BIGINT AS evidence_event_count FROM inc LEFT JOIN em USING (t)
LEFT JOIN days ON days.event_type = et AND days.d BETWEEN inc.d - 2 AND inc.d GROUP BY 1""")


# --- cascades over all nine edges ---------------------------------------------------------------
def pairs(s, d):
    return keep(("whole pairs", d), lambda: cascades.cascade_pairs_from_events(found(s, d, detect.LOOK), star.whole_panel_events(s, d), types=types(s, d)))


_PAIRS = _INC + detect.PAIR_SQL[len(inc_sql()):]
add("c1_whole_cascade_pairs", pairs, f"WITH {_PAIRS} SELECT a_id, b_id, tw AS temporal_weight, ov AS overlap, score FROM cp")
add("c2_whole_components", lambda s, d: cascades.components(pairs(s, d)),
    f"WITH RECURSIVE {_PAIRS}, {detect.COMP_SQL} SELECT id AS incident_id, c AS component FROM comp")

# --- health with all 15 scored metrics ------------------------------------------------------------
_DOMS, _OVER = health_cols()
_LAST = f"lv AS (SELECT m, arg_max(v, d) AS v FROM gold WHERE v IS NOT NULL AND d BETWEEN {D} - 7 AND {D} GROUP BY m)"
_STATUS = "CASE WHEN s >= .8 THEN 'healthy' WHEN s >= .5 THEN 'degraded' WHEN s >= .2 THEN 'warning' ELSE 'critical' END"
add("h1_whole_metric_scores", lambda s, d: r(health.metric_scores(ranking.latest_by_metric(gold(s, d), AS_OF)).drop("metric_date"), "score"),
    f"WITH {_GOLD}, {_LAST}, {scored_sql('lv')} SELECT m AS metric_name, v AS metric_value, dom AS domain, w AS weight, round(s, 4) AS score, {_STATUS} AS status FROM sc")
add("h4_whole_daily_health", lambda s, d: r(text_date(health.daily_health(gold(s, d))), *_HC),
    f"WITH {_GOLD}, gv AS (SELECT * FROM gold WHERE v IS NOT NULL), {scored_sql('gv')} "
    f"SELECT strftime(d, '%Y-%m-%d') AS metric_date, {_DOMS}, round({_OVER}, 4) AS overall_score, {_GR.format(o=f'({_OVER})')} AS overall_grade FROM sc GROUP BY d")
