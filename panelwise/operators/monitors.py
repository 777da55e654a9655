"""Monitor rules, alerts, suppression, routing and lifecycle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwise import config
from panelwise.session import literal_table, written

_TOKEN = re.compile(r"\s*(?:(value|baseline)\b|(abs|min|max)\b|(\d+(?:\.\d+)?)|(>=|<=|==|!=|[-+*/()<>,])|(and|or|not)\b)")

# --- monitors recommended per incident type: (metric, condition, frequency) (fixed values)
RECOMMENDED = {
    "refund_spike": [("refund_rate", "value > baseline * 2.0", "hourly"), ("daily_refunds", "value > baseline * 1.5", "daily")],
    "fulfillment_sla_degradation": [("delivery_delay_rate", "value > baseline * 1.5", "daily"), ("fulfillment_backlog", "value > baseline * 2.0", "daily")],
    "support_load_surge": [("ticket_volume", "value > baseline * 2.0", "hourly"), ("ticket_backlog", "value > baseline * 1.5", "daily")],
    "churn_acceleration": [("churn_proxy", "value > baseline * 1.5", "daily"), ("review_score_avg", "value < baseline * 0.8", "daily")],
    "margin_compression": [("margin_proxy", "value < baseline * 0.7", "daily"), ("expense_ratio", "value > baseline * 1.3", "daily")],
    "liquidity_crunch_risk": [("net_cash_proxy", "value < baseline * 0.5", "daily"), ("ar_aging_amount", "value > baseline * 1.5", "daily")],
    "supplier_dependency_failure": [("supplier_delay_rate", "value > baseline * 2.0", "daily"), ("supplier_delay_severity", "value > baseline * 1.5", "daily")],
    "customer_satisfaction_regression": [("review_score_avg", "value < baseline * 0.85", "daily"), ("review_score_trend", "value < -0.1", "daily")],
}


def condition_column(text: str) -> Column:
    """A condition over ``value`` and ``baseline`` as a column; anything else is refused."""
    pos = 0
    while pos < len(text.rstrip()):
        m = _TOKEN.match(text, pos)
        if not m:
            raise ValueError(f"condition not allowed: {text!r}")
        pos = m.end()
    sql = re.sub(r"\bmin\b", "least", re.sub(r"\bmax\b", "greatest", text)).replace("==", "=")
    return F.coalesce(F.expr(sql).cast("boolean"), F.lit(False))


def evaluate_monitors(rules: list[tuple], gold: DataFrame, as_of: str) -> DataFrame:
    """Fire rules (monitor_id, metric_name, condition, window_days, severity) on their own window.

    ``rules`` is the rule table held by the caller (one entry per monitor).
    """
    table = literal_table(gold.sparkSession, rules, "monitor_id string, metric_name string, condition string, window_days int, severity string")
    end = F.lit(as_of).cast("date")
    hits = gold.where("metric_value is not null").join(F.broadcast(table), "metric_name") \
        .where((F.col("metric_date") <= end) & (F.col("metric_date") >= F.date_sub(end, F.col("window_days"))))
    stats = hits.groupBy("monitor_id", "metric_name", "condition", "severity").agg(
        F.max_by("metric_value", "metric_date").alias("value"), F.avg("metric_value").alias("baseline"), F.max("metric_date").alias("metric_date"))
    fired = F.lit(False)
    for text in sorted({r[2] for r in rules}):
        fired = F.when(F.col("condition") == text, condition_column(text)).otherwise(fired)
    return stats.withColumn("triggered", fired)


def render_alerts(alerts: DataFrame, template: str) -> DataFrame:
    """Fill {value}, {baseline} and {multiplier}; the multiplier of a zero baseline is 'inf'."""
    times = F.coalesce(F.format_number(F.try_divide("value", "baseline"), 2), F.lit("inf"))
    message = F.lit(template)
    for name, text in (("{value}", F.format_number("value", 4)), ("{baseline}", F.format_number("baseline", 4)), ("{multiplier}", times)):
        message = F.replace(message, F.lit(name), text)
    return alerts.withColumn("message", message)


def suppress(alerts: DataFrame, hours: float = config.SUPPRESSION_HOURS) -> DataFrame:
    """Mark alerts that follow an emitted alert of the same monitor too closely.

    Suppressed alerts do not extend the window, so what an emitted alert leads
    to is fixed: the monitor's first alert at least ``hours`` later. Times are
    cut into buckets of that length, and each time finds its successor in the
    next bucket or, if that has none, at the start of the next bucket in use.
    An alert with nothing in the span before it is always emitted; from these
    all others are reached by following successors, twice as far in every
    round. No task holds the alerts of a whole monitor.
    """
    span = int(hours * 3600 * 1_000_000)
    times = written(alerts.where("triggered_at IS NOT NULL").select("monitor_id", F.unix_micros("triggered_at").alias("t")).distinct()
                        .withColumn("b", F.floor(F.col("t") / span)))
    wb = W.partitionBy("monitor_id").orderBy("b")  # one row per bucket in use
    buckets = written(times.groupBy("monitor_id", "b").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
                          .withColumns({"before": F.lag("hi").over(wb), "after": F.lead("lo").over(wb), "after_b": F.lead("b").over(wb), "after2": F.lead("lo", 2).over(wb)}))
    w = W.partitionBy("monitor_id", "b").orderBy("t")
    starts = times.withColumn("prev", F.lag("t").over(w)).join(buckets.select("monitor_id", "b", "before"), ["monitor_id", "b"]) \
        .withColumn("prev", F.coalesce("prev", "before")).where("prev IS NULL OR t - prev >= " + str(span)).select("monitor_id", "t")
    # ask the next bucket for the first time not below t + span
    asked = times.select("monitor_id", (F.col("b") + 1).alias("b"), (F.col("t") + span).alias("at"), F.col("t").alias("of")) \
        .unionByName(times.select("monitor_id", "b", F.col("t").alias("at"), F.lit(None).cast("long").alias("of")))
    later = W.partitionBy("monitor_id", "b").orderBy("at").rangeBetween(0, W.unboundedFollowing)
    near = asked.withColumn("found", F.min(F.when(F.col("of").isNull(), F.col("at"))).over(later)).where("of IS NOT NULL") \
        .select("monitor_id", F.col("of").alias("t"), "found", (F.col("b") - 1).alias("b"))
    beyond = F.when(F.col("after_b") == F.col("b") + 1, F.col("after2")).otherwise(F.col("after"))
    jumps = written(near.join(buckets, ["monitor_id", "b"]).select("monitor_id", "t", F.coalesce("found", beyond).alias("to")).where("to IS NOT NULL"))
    emitted = written(starts)
    while True:
        reached = emitted.join(jumps, ["monitor_id", "t"]).select("monitor_id", F.col("to").alias("t")).join(emitted, ["monitor_id", "t"], "left_anti").distinct()
        reached = written(reached)
        if reached.isEmpty():
            break
        emitted = written(emitted.unionByName(reached))
        onward = jumps.select("monitor_id", F.col("t").alias("to"), F.col("to").alias("further"))
        jumps = written(jumps.join(onward, ["monitor_id", "to"]).select("monitor_id", "t", F.col("further").alias("to")))
    first = alerts.groupBy("monitor_id", F.unix_micros("triggered_at").alias("_t")).agg(F.min("alert_id").alias("_first"))
    passed = first.join(emitted.select("monitor_id", F.col("t").alias("_t")), ["monitor_id", "_t"])
    return alerts.withColumn("_t", F.unix_micros("triggered_at")).join(passed, ["monitor_id", "_t"], "left") \
        .withColumn("suppressed", ~F.coalesce(F.col("alert_id") == F.col("_first"), F.lit(False))).drop("_t", "_first")


def route(alerts: DataFrame) -> DataFrame:
    """Channels and escalation minutes by severity."""
    rows = [(k, ",".join(c), m) for k, (c, m) in config.ALERT_ROUTES.items()]
    table = literal_table(alerts.sparkSession, rows, "severity string, channels string, escalation_minutes int")
    return alerts.join(F.broadcast(table), "severity", "left").withColumn("channels", F.split("channels", ","))


def alert_state(log: DataFrame) -> DataFrame:
    """Latest status and incident link of every alert from an append-only log."""
    return log.groupBy("alert_id").agg(
        F.max_by("status", F.struct("changed_at", "status")).alias("status"), F.max("changed_at").alias("changed_at"),
        F.max_by("incident_id", F.when(F.col("incident_id").isNotNull(), F.struct("changed_at", "incident_id"))).alias("incident_id"))


def active_alerts(alerts: DataFrame, log: DataFrame) -> DataFrame:
    """Alerts that are still active, most severe first."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in config.SEVERITY_RANK.items() for x in kv]), F.col("severity"))
    return alerts.join(alert_state(log), "alert_id", "left").where(F.coalesce("status", F.lit("active")) == "active") \
        .withColumn("severity_rank", rank)


def recommended_monitors(inc: DataFrame) -> DataFrame:
    """Two monitors per incident, severity high for high and critical incidents."""
    rows = [(k, *r) for k, v in RECOMMENDED.items() for r in v]
    table = literal_table(inc.sparkSession, rows, "incident_type string, metric_name string, condition string, frequency string")
    return inc.join(F.broadcast(table), "incident_type").select(
        F.concat_ws(":", F.lit("monitor"), "incident_id", "metric_name").alias("monitor_id"), "incident_id", "metric_name", "condition", "frequency",
        F.lit(30).alias("window_days"), F.when(F.col("severity").isin("high", "critical"), "high").otherwise("medium").alias("severity_if_triggered"))
