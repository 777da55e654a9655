"""Recommendation feed and postmortem rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwise.operators.ranking import dedup_first

# --- action per weak metric (fixed values) -----------------------------------------
METRIC_ACTIONS = {
    "margin_proxy": "Review profit margin drivers — identify high-cost products or expenses",
    "refund_rate": "Investigate refund root causes — review recent refund incidents",
    "net_cash_proxy": "Improve cash flow — prioritize collections and expense timing",
    "expense_ratio": "Audit expense categories — find areas to trim without impact",
    "dso_proxy": "Review accounts receivable aging report — follow up on overdue invoices",
    "delivery_delay_rate": "Address fulfillment bottlenecks — check supplier and logistics",
    "fulfillment_backlog": "Reduce order backlog — increase capacity or prioritize orders",
    "supplier_delay_rate": "Engage with delayed suppliers — consider backup vendors",
    "order_volume": "Review order trends — investigate volume decline if unexpected",
    "avg_delivery_delay_days": "Improve delivery SLA — trace delay sources",
    "review_score_avg": "Address customer satisfaction — review negative feedback",
    "ticket_backlog": "Tackle support ticket backlog — increase resolution capacity",
    "churn_proxy": "Contact at-risk customers — review churn patterns",
    "avg_resolution_time": "Improve support resolution time — streamline processes",
    "review_score_trend": "Stabilize review scores — identify declining drivers",
}
REVENUE_ACTION = "Contact customers with high revenue at risk — prioritize collections"
CHURN_ACTION = "Reach out to churn-risk customers — offer retention incentives"


def recommendations(scores: DataFrame, postmortems: DataFrame, blast: DataFrame, n: int = 5, recent: int | None = None, recent_blast: int | None = None) -> DataFrame:
    """Union of weak metrics, recent postmortem actions and high exposure; deduplicated, top n.

    All incidents count; ``recent`` and ``recent_blast`` restrict the feed to so many of the newest ones.
    """
    actions = F.create_map(*[F.lit(x) for kv in METRIC_ACTIONS.items() for x in kv])
    weak = scores.where(F.col("status").isin("critical", "warning")).select(
        F.element_at(actions, F.col("metric_name")).alias("action"), F.lit("metric").alias("source"), F.when(F.col("status") == "critical", 1).otherwise(2).alias("priority"))
    newest = [F.desc("detected_at"), F.col("incident_id")]
    done = (postmortems.orderBy(*newest).limit(recent) if recent else postmortems).select(F.explode(F.slice("recommendations", 1, 2)).alias("action"), F.lit("postmortem").alias("source"), F.lit(2).alias("priority"))
    risky = (blast.orderBy(*newest).limit(recent_blast) if recent_blast else blast).withColumn("action", F.when(F.col("revenue_exposure") > 5000, REVENUE_ACTION)
                                                                 .when(F.col("churn_exposure") > 3, CHURN_ACTION)).where("action is not null") \
        .select("action", F.lit("blast_radius").alias("source"), F.when(F.col("revenue_exposure") > 5000, 1).otherwise(2).alias("priority"))
    both = weak.unionByName(done).unionByName(risky)
    first = dedup_first(both, [F.substring("action", 1, 50), F.col("source")], [F.col("priority"), F.col("action")])
    return first.orderBy("priority", "action").limit(n)


def _title(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def _duration(days: Column) -> Column:
    return F.concat(F.format_number(days.cast("double"), 1), F.lit(" days"))


def postmortems(inc: DataFrame, causes: DataFrame, blast: DataFrame) -> DataFrame:
    """One report row per incident from the incident, its ranked causes and its blast radius."""
    c = causes.groupBy("incident_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("metric_name"))).alias("root_cause"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("root_score"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank").between(2, 3), F.struct("rank", "metric_name")))), lambda x: x["metric_name"]).alias("contributing_factors"))
    x = inc.join(c, "incident_id", "left").join(blast.drop("incident_type"), "incident_id", "left")
    days = F.datediff("window_end", "window_start") + 1
    bad = F.col("severity").isin("high", "critical")
    advice = F.array_compact(F.array(
        F.when(bad, "Escalate to management"), F.when(F.col("churn_exposure") > 10, "Start a retention campaign for the customers at risk"),
        F.when(F.col("refund_exposure") > 10000, "Reserve funds for refunds"), F.lit("Deploy the recommended monitors")))
    timeline = F.array_sort(F.array(
        F.struct(F.col("window_start").cast("timestamp").alias("at"), F.concat("primary_metric", F.lit(" left its normal range")).alias("entry")),
        F.struct(F.col("detected_at").alias("at"), F.concat("incident_type", F.lit(" detected with "), "confidence", F.lit(" confidence")).alias("entry"))))
    return x.select(
        "incident_id", "detected_at", "severity",
        F.concat(_title(F.col("incident_type")), F.lit(" Incident"), F.coalesce(F.concat(F.lit(" - Root Cause: "), _title(F.col("root_cause"))), F.lit(""))).alias("title"),
        _duration(days).alias("duration"),
        F.format_string("%s affecting %d customers, %d in revenue at risk", F.replace("incident_type", F.lit("_"), F.lit(" ")),
                        F.coalesce("customers_affected", F.lit(0)), F.round(F.coalesce("revenue_exposure", F.lit(0.0)), 2).cast("long")).alias("summary"),
        timeline.alias("timeline"), F.coalesce("root_cause", F.lit("unknown")).alias("root_cause"), "root_score",
        F.coalesce("contributing_factors", F.array().cast("array<string>")).alias("contributing_factors"), advice.alias("recommendations"))


def compare_models(table: DataFrame, metrics: list[str]) -> DataFrame:
    """Long comparison of models per metric with their rank and the best flag."""
    long = table.unpivot(["model"], metrics, "metric", "value")
    w = W.partitionBy("metric").orderBy(F.desc("value"), "model")
    return long.withColumn("rank", F.row_number().over(w)).withColumn("is_best", F.col("rank") == 1)
