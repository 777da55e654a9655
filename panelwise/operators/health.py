"""Metric, domain and overall health scores, trends, error budget and factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise import config
from panelwise.functions.stats import logistic
from panelwise.operators.ranking import latest_by_metric
from panelwise.session import literal_table


def _config(df: DataFrame) -> DataFrame:
    # fixed table of 15 metrics
    return F.broadcast(literal_table(df.sparkSession, config.HEALTH_METRICS,
                                     "domain string, metric_name string, weight double, direction string, healthy double, critical double"))


def metric_scores(values: DataFrame) -> DataFrame:
    """Score 0..1 per metric value: 1 inside the healthy bound, 0 beyond the critical one, logistic between."""
    v, good, bad = F.col("metric_value"), F.col("healthy"), F.col("critical")
    lower = F.col("direction") == "lower"
    fraction = (v - bad) / (good - bad)
    score = F.when(F.when(lower, v <= good).otherwise(v >= good), 1.0) \
        .when(F.when(lower, v >= bad).otherwise(v <= bad), 0.0).otherwise(logistic(fraction, 0.5, 6.0))
    return values.join(_config(values), "metric_name").withColumn("score", score).drop("direction", "healthy", "critical") \
        .withColumn("status", F.when(F.col("score") >= 0.8, "healthy").when(F.col("score") >= 0.5, "degraded")
                    .when(F.col("score") >= 0.2, "warning").otherwise("critical"))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def health_from_scores(scores: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Weighted domain scores (50 without data) and the weighted overall score per key."""
    cols = []
    for d in config.DOMAIN_WEIGHTS:
        here = F.col("domain") == d
        cols.append(F.coalesce(F.try_divide(
            100.0 * F.sum(F.when(here, F.col("weight") * F.col("score"))), F.sum(F.when(here, F.col("weight")))), F.lit(50.0)).alias(d))
    wide = scores.groupBy(*keys).agg(*cols) if keys else scores.agg(*cols)
    overall = sum((F.col(d) * w for d, w in config.DOMAIN_WEIGHTS.items()), F.lit(0.0))
    return wide.withColumn("overall_score", overall).withColumn("overall_grade", grade(F.col("overall_score")))


def health_score(gold: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return health_from_scores(metric_scores(latest_by_metric(gold, as_of, days)))


def health_trend(gold: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Overall score of this window against the window before it (one pass over the gold rows)."""
    end = F.lit(as_of).cast("date")
    age = F.datediff(end, F.col("metric_date"))
    both = gold.where((age >= 0) & (age <= 2 * days) & F.col("metric_value").isNotNull()) \
        .select("metric_name", "metric_date", "metric_value", F.explode(F.array_compact(F.array(
            F.when(age <= days, "current"), F.when(age >= days, "previous")))).alias("period"))
    latest = both.groupBy("period", "metric_name").agg(F.max_by("metric_value", "metric_date").alias("metric_value"))
    scored = health_from_scores(metric_scores(latest), ("period",))
    out = scored.agg(F.max(F.when(F.col("period") == "current", F.col("overall_score"))).alias("current_score"),
                     F.max(F.when(F.col("period") == "previous", F.col("overall_score"))).alias("previous_score"))
    delta = F.col("current_score") - F.coalesce("previous_score", "current_score")
    return out.withColumn("delta", delta).withColumn(
        "trend", F.when(delta > 2, "improving").when(delta < -2, "degrading").otherwise("stable"))


def daily_health(gold: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    g = gold.where("metric_value is not null")
    return health_from_scores(metric_scores(g), (*by, "metric_date"))


def error_budget(daily: DataFrame, as_of: str, slo_target: float = 99.5, window_days: int = 30,
                 score_threshold: float | None = None) -> DataFrame:
    """Minutes of budget, consumption, burn rate, projected exhaustion date and status."""
    limit = slo_target if score_threshold is None else score_threshold
    end = F.lit(as_of).cast("date")
    used = daily.where((F.col("metric_date") >= F.date_sub(end, window_days)) & (F.col("metric_date") <= end)) \
        .agg(F.count("*").alias("days"), F.count_if(F.col("overall_score") < limit).alias("breached_days"))
    budget = window_days * 1440 * (100.0 - slo_target) / 100.0
    consumed = F.col("breached_days") * 1440.0
    elapsed = F.greatest(F.col("days"), F.lit(1))
    remaining = F.greatest(F.lit(0.0), (budget - consumed) / budget * 100) if budget > 0 else F.lit(100.0)
    burn = consumed / (elapsed / window_days * budget) if budget > 0 else F.lit(0.0)
    out = used.select("days", "breached_days", F.lit(budget).alias("budget_minutes"), consumed.alias("consumed_minutes"),
                      remaining.alias("remaining_pct"), burn.alias("burn_rate"))
    left = (F.col("budget_minutes") - F.col("consumed_minutes")) / (F.col("consumed_minutes") / elapsed)
    return out.withColumn("exhaustion_date", F.when(
        (F.col("burn_rate") > 1) & (F.col("remaining_pct") > 0), F.date_add(end, F.floor(left).cast("int")))) \
        .withColumn("status", F.when(F.col("remaining_pct") <= 0, "exhausted")
                    .when((F.col("remaining_pct") <= 25) | (F.col("burn_rate") > 2), "critical")
                    .when((F.col("remaining_pct") <= 50) | (F.col("burn_rate") > 1.5), "warning").otherwise("healthy"))


def contributing_factors(scores: DataFrame, n: int = 10) -> DataFrame:
    """Impact times weight, worst negative contributions first."""
    s = F.col("score")
    x = scores.withColumn("contribution_pct", F.round((1.0 - s) * F.col("weight") * 100, 1)) \
        .withColumn("direction", F.when(s < 0.6, "negative").when(s < 0.8, "neutral").otherwise("positive"))
    first = F.when(F.col("direction") == "negative", -F.col("contribution_pct")).otherwise(0.0)
    return x.orderBy(first, s, "metric_name").limit(n).select("metric_name", "domain", "metric_value", "score", "status", "contribution_pct", "direction")
