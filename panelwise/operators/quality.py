"""Data-quality scores, reject side-outputs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise import config
from panelwise.functions.stats import safe_divide
from panelwise.sources.raw import PAYLOAD

MAX_AMOUNT = 1e12
#: The attributes of events that ``with_scores`` reads.
SCORED = "balance double, line_items array<struct<amount:double>>"


def completeness(bronze: DataFrame) -> DataFrame:
    """Share of the required payload fields that are present, per raw record."""
    p = bronze.withColumn("p", F.from_json("raw_payload", PAYLOAD))
    score = F.lit(1.0)
    for kind, fields in config.REQUIRED_FIELDS.items():
        present = [F.col(f"p.{f}").isNotNull().cast("int") for f in fields]
        total = present[0]
        for x in present[1:]:
            total = total + x
        score = F.when(F.col("entity_type") == kind, total / float(len(fields))).otherwise(score)
    return p.select("record_id", "entity_type", score.alias("completeness"))


def consistency(ev: DataFrame, as_of: str) -> Column:
    """Share of the applicable checks that hold for an event (see ``with_scores``)."""
    items = F.col("attributes.line_items")
    line_total = F.aggregate(items, F.lit(0.0), lambda a, x: a + F.coalesce(x["amount"], F.lit(0.0)))
    has_lines = F.col("amount").isNotNull() & (F.coalesce(F.size(items), F.lit(0)) > 0)
    lines_ok = F.coalesce(F.try_divide(F.abs(F.col("amount") - line_total), F.col("amount")) < 0.01, F.lit(False))
    past = F.col("event_time") <= F.lit(as_of).cast("timestamp")
    has_balance = (F.col("entity_type") == "invoice") & F.col("attributes.balance").isNotNull() & F.col("amount").isNotNull()
    balance_ok = F.col("attributes.balance") <= F.col("amount")
    checks = F.lit(1) + has_lines.cast("int") + has_balance.cast("int")
    passed = past.cast("int") + (has_lines & lines_ok).cast("int") + F.coalesce(has_balance & balance_ok, F.lit(False)).cast("int")
    return passed / checks


def timeliness(ingested: Column, event_time: Column) -> Column:
    """1.0 / 0.8 / 0.6 / 0.4 by whole days between the event and its ingestion; 0.8 if unknown."""
    days = F.floor((F.unix_micros(ingested) - F.unix_micros(event_time)) / 86400e6)
    return F.when(days.isNull(), 0.8).when(days < 1, 1.0).when(days < 7, 0.8).when(days < 30, 0.6).otherwise(0.4)


def with_scores(ev: DataFrame, as_of: str) -> DataFrame:
    return ev.withColumn("consistency", consistency(ev, as_of)) \
        .withColumn("timeliness", timeliness(F.col("ingested_at"), F.col("event_time")))


def reject_reasons() -> Column:
    """Reasons an event violates the canonical schema."""
    return F.array_compact(F.array(
        F.when(~F.coalesce(F.upper("currency").rlike("^[A-Z]{3}$"), F.lit(False)), "invalid_currency"),
        F.when(F.abs("amount") > MAX_AMOUNT, "amount_out_of_range"),
        F.when(F.col("event_time").isNull(), "missing_event_time")))


def split_valid(ev: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid events with normalised currency and amount, rejected events with reasons)."""
    marked = ev.withColumn("reasons", reject_reasons())
    valid = marked.where(F.size("reasons") == 0).drop("reasons") \
        .withColumn("currency", F.upper("currency")).withColumn("amount", F.round("amount", 2))
    return valid, marked.where(F.size("reasons") > 0)


def batch_totals(ev: DataFrame) -> DataFrame:
    bad = F.size(reject_reasons()) > 0
    return ev.agg(F.count("*").alias("total"), F.count_if(~bad).alias("valid"), F.count_if(bad).alias("rejected"))


def quality_issues(ev: DataFrame) -> DataFrame:
    """Count per flag; the kind of issue follows from the flag name."""
    f = ev.select(F.explode("data_quality_flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("count"))
    return f.withColumn("issue_type", F.when(F.col("flag").startswith("missing"), "missing").otherwise("invalid"))


def advisory(score: Column) -> Column:
    return F.when(score >= 0.95, "excellent").when(score >= 0.85, "good").when(score >= 0.70, "moderate").otherwise("low")


def quality_report(completeness_scores: DataFrame, scored_events: DataFrame) -> DataFrame:
    """Weighted batch score from per-record completeness and per-event consistency and timeliness."""
    c = completeness_scores.agg(F.coalesce(F.avg("completeness"), F.lit(1.0)).alias("completeness"))
    e = scored_events.agg(F.count("*").alias("events"), F.coalesce(F.avg("consistency"), F.lit(1.0)).alias("consistency"),
                          F.coalesce(F.avg("timeliness"), F.lit(1.0)).alias("timeliness"))
    both = e.withColumn("completeness", c.scalar())
    overall = 0.4 * F.col("completeness") + 0.4 * F.col("consistency") + 0.2 * F.col("timeliness")
    return both.withColumn("overall", overall).withColumn("advisory", advisory(F.col("overall")))


def adapter_quality_report(ev: DataFrame, total: DataFrame) -> DataFrame:
    """File batches: completeness from flags per valid record, consistency from the valid share.

    ``total`` is a one-row, one-column frame with the number of input records.
    """
    a = ev.agg(F.count_distinct("source_entity_id").alias("valid"), F.coalesce(F.sum(F.size("data_quality_flags")), F.lit(0)).alias("flags")) \
        .withColumn("total", total.scalar())
    comp = F.when(F.col("valid") > 0, F.greatest(F.lit(0.0), 1.0 - F.col("flags") / (5.0 * F.col("valid")))).otherwise(1.0)
    cons = F.when(F.col("total") > 0, F.col("valid") / F.col("total")).otherwise(1.0)
    overall = 0.4 * comp + 0.4 * cons + 0.2
    return a.select("total", "valid", (F.col("total") - F.col("valid")).alias("rejected"), comp.alias("completeness"),
                    cons.alias("consistency"), F.lit(1.0).alias("timeliness"), overall.alias("overall"), advisory(overall).alias("advisory"))


def coverage_quality(gold: DataFrame, lo: str, hi: str) -> DataFrame:
    """Share of the expected days a metric has in [lo, hi], as a quality band."""
    expected = F.greatest(F.datediff(F.lit(hi).cast("date"), F.lit(lo).cast("date")) + 1, F.lit(1))
    days = gold.where((F.col("metric_date") >= F.lit(lo).cast("date")) & (F.col("metric_date") <= F.lit(hi).cast("date"))
                      & F.col("metric_value").isNotNull()).groupBy("metric_name").agg(F.count("*").alias("days"))
    share = F.least(F.lit(1.0), safe_divide(F.col("days"), expected))
    return days.select("metric_name", "days", share.alias("coverage"),
                       F.when(share >= 0.9, 1.0).when(share >= 0.7, 0.9).when(share >= 0.5, 0.75).otherwise(0.5).alias("quality"))
