"""Incident rules over per-day z-scores, with confidence, evidence and quality.

Z-scores are turned into one row per day; the eight rules are evaluated in that
one row and fan out to incident rows. Evidence is kept as rows, never as an
unbounded array; counts come from daily event counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise import config

RULE_METRICS = [
    "refund_rate", "daily_refunds", "delivery_delay_rate", "fulfillment_backlog", "ticket_volume", "ticket_backlog",
    "avg_resolution_time", "churn_proxy", "customer_concentration", "margin_proxy", "expense_ratio",
    "net_cash_proxy", "ar_aging_amount", "supplier_delay_rate", "supplier_delay_severity", "review_score_avg",
    "review_score_trend",
]


def z_wide(z: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per day with a struct (value, median, z, flag) per rule metric."""
    cell = F.struct(F.col("metric_value").alias("value"), "median", F.col("zscore").alias("z"),
                    F.col("is_anomaly").alias("flag"))
    return z.where(F.col("metric_name").isin(RULE_METRICS)).groupBy(*by, "metric_date").agg(
        *[F.max(F.when(F.col("metric_name") == m, cell)).alias(m) for m in RULE_METRICS])


def _z(metric: str) -> Column:
    return F.col(f"{metric}.z")


def _v(metric: str) -> Column:
    return F.col(f"{metric}.value")


def _high(metric: str, gate: float = 3.0) -> Column:
    return F.coalesce(F.col(f"{metric}.flag") & (_z(metric) > gate), F.lit(False))


def _low(metric: str, gate: float = -3.0) -> Column:
    return F.coalesce(F.col(f"{metric}.flag") & (_z(metric) < gate), F.lit(False))


def _ladder(x: Column, *steps: tuple[float, str]) -> Column:
    out = None
    for bound, name in steps:
        out = F.when(x > bound, name) if out is None else out.when(x > bound, name)
    return out.otherwise("low")


def _larger(first: str, first_on: Column, second: str, second_on: Column, first_size: Column, second_size: Column) -> Column:
    """Name of the primary metric: the second one only if it fires alone or is larger."""
    return F.when(second_on & (~first_on | (second_size > F.coalesce(first_size, F.lit(0.0)))), second).otherwise(first)


def _rules() -> list[tuple[str, Column, Column, Column, list[str]]]:
    """(type, trigger, primary metric, severity, supporting metrics) for each incident type."""
    delay, backlog = "delivery_delay_rate", "fulfillment_backlog"
    tickets, waiting = "ticket_volume", "ticket_backlog"
    rate, depth = "supplier_delay_rate", "supplier_delay_severity"
    margin, cost = "margin_proxy", "expense_ratio"
    cash, overdue = "net_cash_proxy", "ar_aging_amount"
    score, trend = "review_score_avg", "review_score_trend"
    falling = F.coalesce(_v(trend) < -0.1, F.lit(False))
    slow = _high("avg_resolution_time", 2.0)
    concentrated = F.coalesce(_v("customer_concentration") > 0.5, F.lit(False))

    def primary_size(p: Column, a: str, b: str) -> Column:
        return F.abs(F.when(p == a, _z(a)).otherwise(_z(b)))

    fulfil = _larger(delay, _high(delay), backlog, _high(backlog), _z(delay), _z(backlog))
    support = _larger(tickets, _high(tickets), waiting, _high(waiting), _z(tickets), _z(waiting))
    supplier = _larger(rate, _high(rate), depth, _high(depth), _z(rate), _z(depth))
    squeeze = _larger(margin, _low(margin), cost, _high(cost), F.abs(_z(margin)), _z(cost))
    liquid = F.when(_low(cash), cash).otherwise(overdue)
    mood = _larger(score, _low(score, -2.5), trend, falling, F.abs(_v(score)), F.abs(_v(trend)))
    support_z, liquid_z = primary_size(support, tickets, waiting), primary_size(liquid, cash, overdue)
    squeeze_z = F.greatest(F.coalesce(F.abs(_z(margin)), F.lit(0.0)), F.coalesce(F.abs(_z(cost)), F.lit(0.0)))
    mood_size = F.greatest(F.coalesce(F.abs(_z(score)), F.lit(0.0)), F.when(falling, F.abs(_v(trend)) * 20).otherwise(0.0))
    common = ((6.0, "high"), (4.0, "medium"))
    return [
        ("refund_spike", _high("refund_rate"), F.lit("refund_rate"),
         F.when((_z("refund_rate") > 8) & (_v("refund_rate") > 0.10), "critical")
         .otherwise(_ladder(_z("refund_rate"), *common)), ["daily_refunds"]),
        ("fulfillment_sla_degradation", _high(delay) | _high(backlog), fulfil,
         _ladder(primary_size(fulfil, delay, backlog), *common), [delay, backlog]),
        ("support_load_surge", _high(tickets) | _high(waiting), support,
         F.when(slow & (support_z > 4), "high").otherwise(_ladder(support_z, *common)),
         [tickets, waiting, "avg_resolution_time"]),
        ("churn_acceleration", _high("churn_proxy", 2.5), F.lit("churn_proxy"),
         F.when(concentrated & (_z("churn_proxy") > 4), "critical")
         .otherwise(_ladder(_z("churn_proxy"), (5.0, "high"), (3.5, "medium"))), ["customer_concentration"]),
        ("margin_compression", _low(margin) | _high(cost), squeeze,
         _ladder(squeeze_z, (6.0, "critical"), (4.5, "high"), (3.5, "medium")), [margin, cost]),
        ("liquidity_crunch_risk", _low(cash) | _high(overdue), liquid,
         F.when(_low(cash) & _high(overdue), "critical").otherwise(_ladder(liquid_z, *common)), [cash, overdue]),
        ("supplier_dependency_failure", _high(rate) | _high(depth), supplier,
         _ladder(primary_size(supplier, rate, depth), *common), [rate, depth]),
        ("customer_satisfaction_regression", _low(score, -2.5) | falling, mood,
         _ladder(mood_size, (5.0, "high"), (3.5, "medium")), [score, trend]),
    ]


def _support(primary: Column, metrics: list[str]) -> Column:
    cells = [F.when((primary != m) & F.col(m).isNotNull(), F.struct(
        F.lit(m).alias("metric"), _v(m).alias("value"), F.col(f"{m}.median").alias("baseline"), _z(m).alias("zscore")))
        for m in metrics]
    return F.array_compact(F.array(*cells))


def incidents(z: DataFrame, ml: DataFrame | None = None, breaks: DataFrame | None = None,
              by: tuple[str, ...] = (), window_days: int = 1) -> DataFrame:
    """All incidents of all days.

    ``ml`` has (metric_date, is_anomaly), ``breaks`` has (metric_name,
    metric_date, has_change); both only raise the confidence. The incident
    window is the trailing ``window_days`` calendar days.
    """
    wide = z_wide(z, by)
    cells = []
    for order, (kind, trigger, primary, severity, supporting) in enumerate(_rules()):
        pick = F.coalesce(*[F.when(primary == m, F.col(m)) for m in RULE_METRICS])
        cells.append(F.when(trigger, F.struct(
            F.lit(kind).alias("incident_type"), F.lit(order).alias("rule_order"), primary.alias("primary_metric"),
            severity.alias("severity"), pick.alias("p"), _support(primary, supporting).alias("supporting_metrics"))))
    fired = wide.select(*by, "metric_date", F.inline(F.array_compact(F.array(*cells))))
    keys = [*by, "metric_date"]
    if ml is not None:
        fired = fired.join(ml.select(*keys, F.col("is_anomaly").alias("ml_flag")), keys, "left")
    else:
        fired = fired.withColumn("ml_flag", F.lit(False))
    if breaks is not None:
        cp = breaks.select(*keys, F.col("metric_name").alias("primary_metric"), F.col("has_change").alias("cp_flag"))
        fired = fired.join(cp, [*keys, "primary_metric"], "left")
    else:
        fired = fired.withColumn("cp_flag", F.lit(False))
    ml_flag, cp_flag = F.coalesce("ml_flag", F.lit(False)), F.coalesce("cp_flag", F.lit(False))
    stat = F.col("p.flag")
    return fired.select(
        F.concat_ws(":", "incident_type", *by, F.date_format("metric_date", "yyyy-MM-dd")).alias("incident_id"),
        *by, "metric_date", "incident_type", "severity",
        confidence(stat, ml_flag, cp_flag).alias("confidence"),
        F.array_compact(F.array(F.lit("mad_zscore"), F.when(ml_flag, F.lit("isolation_forest")),
                                F.when(cp_flag, F.lit("changepoint")))).alias("detection_methods"),
        "primary_metric", F.col("p.value").alias("primary_value"), F.col("p.median").alias("primary_baseline"),
        F.col("p.z").alias("primary_zscore"), "supporting_metrics",
        F.date_sub("metric_date", window_days - 1).alias("window_start"), F.col("metric_date").alias("window_end"),
        # detection runs after the day has ended, rules one after another
        F.timestamp_seconds(F.unix_date("metric_date") * 86400 + 86400 + F.col("rule_order")).alias("detected_at"))


def confidence(stat: Column, ml: Column, change: Column) -> Column:
    return F.when(~stat, "low").when(ml & change, "very_high").when(ml | change, "high").otherwise("medium")


def _windows(inc: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """One row per incident, evidence event type and day of its window."""
    kinds = F.create_map(*[x for k, v in config.EVIDENCE_EVENTS.items()
                           for x in (F.lit(k), F.array(*[F.lit(e) for e in v]))])
    return inc.select(*by, "incident_id", "window_start", "window_end",
                      F.explode(F.element_at(kinds, F.col("incident_type"))).alias("event_type")) \
        .withColumn("event_date", F.explode(F.sequence("window_start", "window_end", F.expr("interval 1 day"))))


def daily_type_counts(ev: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Events per type and day: the small table behind evidence counts and overlaps."""
    return ev.groupBy(*by, "event_type", F.to_date("event_time").alias("event_date")).agg(F.count("*").alias("n"))


def evidence_rows(inc: DataFrame, ev: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(incident_id, event_id) for every event of the incident's types inside its window."""
    e = ev.select(*by, "event_type", F.to_date("event_time").alias("event_date"), "event_id")
    return _windows(inc, by).join(e, [*by, "event_type", "event_date"]).select("incident_id", "event_id")


def evidence_counts(inc: DataFrame, ev: DataFrame, by: tuple[str, ...] = (), types: DataFrame | None = None) -> DataFrame:
    """Evidence events per incident; ``types`` are the events' daily type counts where they are there already."""
    hits = _windows(inc, by).join(daily_type_counts(ev, by) if types is None else types, [*by, "event_type", "event_date"]) \
        .groupBy("incident_id").agg(F.sum("n").alias("evidence_event_count"))
    return inc.select("incident_id").join(hits, "incident_id", "left").fillna(0, subset=["evidence_event_count"])


def window_quality(inc: DataFrame, flagged: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """1 - flagged / all events in the incident window; 0.0 for an empty window.

    ``flagged`` carries (event_time, data_quality_flags) per event.
    """
    daily = flagged.groupBy(*by, F.to_date("event_time").alias("event_date")).agg(
        F.count("*").alias("n"), F.count_if(F.size("data_quality_flags") > 0).alias("bad"))
    days = inc.select(*by, "incident_id", F.explode(F.sequence("window_start", "window_end", F.expr("interval 1 day")))
                      .alias("event_date"))
    q = days.join(daily, [*by, "event_date"], "left").groupBy("incident_id").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    return q.select("incident_id", F.when(F.coalesce("n", F.lit(0)) > 0, 1.0 - F.col("bad") / F.col("n"))
                    .otherwise(0.0).alias("data_quality_score"))
