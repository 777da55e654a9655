"""Linking incidents: pair scores, connected components, summaries, patterns, comparisons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwise import config
from panelwise.functions.stats import erfc
from panelwise.operators.incidents import _windows, daily_type_counts
from panelwise.operators.graph import connected_components
from panelwise.session import written

EMPTY_OVERLAP = 0.1


def candidate_pairs(inc: DataFrame, threshold: float = 0.3, decay_days: float = 3.0,
                    by: tuple[str, ...] = ()) -> DataFrame:
    """Incident pairs that can reach the threshold at all: allowed types, a before b.

    The time weight alone falls under the threshold after a fixed number of
    days, so a joins only the days it can reach (an exact bound, not a cap).
    """
    reach = math.ceil(-decay_days * math.log(threshold)) + 1
    downstream: dict[str, list[str]] = {}
    for a, b in config.CASCADE_EDGES:
        downstream.setdefault(a, []).append(b)
    targets = F.create_map(*[x for k, v in downstream.items()
                             for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    a = inc.select(*by, F.col("incident_id").alias("a_id"), F.col("detected_at").alias("a_at"),
                   F.explode(F.element_at(targets, F.col("incident_type"))).alias("b_type")) \
        .withColumn("_day", F.explode(F.sequence(F.to_date("a_at"), F.date_add(F.to_date("a_at"), reach),
                                                 F.expr("interval 1 day"))))
    b = inc.select(*by, F.col("incident_id").alias("b_id"), F.col("detected_at").alias("b_at"),
                   F.col("incident_type").alias("b_type"), F.to_date("detected_at").alias("_day"))
    days = (F.unix_micros("b_at") - F.unix_micros("a_at")) / 86400e6
    return a.join(b, [*by, "b_type", "_day"]).where("a_at < b_at").select(
        *by, "a_id", "b_id", F.round(F.exp(-days / decay_days), 4).alias("temporal_weight"))


def _scored(pairs: DataFrame, threshold: float) -> DataFrame:
    both = (F.col("a_n") > 0) & (F.col("b_n") > 0)
    overlap = F.when(both, F.round(F.col("shared") / (F.col("a_n") + F.col("b_n") - F.col("shared")), 4)) \
        .otherwise(EMPTY_OVERLAP)
    return pairs.withColumn("overlap", overlap) \
        .withColumn("score", F.round(F.col("temporal_weight") * F.col("overlap"), 4)).where(F.col("score") >= threshold)


def cascade_pairs(inc: DataFrame, threshold: float = 0.3, decay_days: float = 3.0,
                  by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs scored on explicit ``evidence_event_ids`` arrays (small evidence sets)."""
    ids = inc.select(*by, "incident_id", F.array_distinct("evidence_event_ids").alias("ids"))
    pairs = candidate_pairs(inc, threshold, decay_days, by)
    pairs = pairs.join(ids.withColumnRenamed("incident_id", "a_id").withColumnRenamed("ids", "a_ids"), [*by, "a_id"]) \
        .join(ids.withColumnRenamed("incident_id", "b_id").withColumnRenamed("ids", "b_ids"), [*by, "b_id"])
    scored = pairs.withColumn("a_n", F.size("a_ids")).withColumn("b_n", F.size("b_ids")) \
        .withColumn("shared", F.size(F.array_intersect("a_ids", "b_ids")))
    return _scored(scored, threshold).select(*by, "a_id", "b_id", "temporal_weight", "overlap", "score")


def cascade_pairs_from_events(inc: DataFrame, ev: DataFrame, threshold: float = 0.3, decay_days: float = 3.0,
                              by: tuple[str, ...] = (), types: DataFrame | None = None) -> DataFrame:
    """Pairs scored without materialising evidence ids.

    Evidence is (event types x window days) and every event id occurs once, so
    set sizes and intersections are sums of daily event counts. These are
    written, since three joins read them; a caller that has them passes ``types``.
    """
    counts = written(daily_type_counts(ev, by), "type-counts") if types is None else types
    cells = _windows(inc, by).join(counts, [*by, "event_type", "event_date"]) \
        .select(*by, "incident_id", "event_type", "event_date", "n")
    size = cells.groupBy(*by, "incident_id").agg(F.sum("n").alias("size"))
    pairs = candidate_pairs(inc, threshold, decay_days, by)
    a = cells.select(*by, F.col("incident_id").alias("a_id"), "event_type", "event_date", "n")
    b = cells.select(*by, F.col("incident_id").alias("b_id"), "event_type", "event_date")
    shared = pairs.select(*by, "a_id", "b_id").join(a, [*by, "a_id"]).join(b, [*by, "b_id", "event_type", "event_date"]) \
        .groupBy(*by, "a_id", "b_id").agg(F.sum("n").alias("shared"))
    sized = pairs.join(size.select(*by, F.col("incident_id").alias("a_id"), F.col("size").alias("a_n")), [*by, "a_id"], "left") \
        .join(size.select(*by, F.col("incident_id").alias("b_id"), F.col("size").alias("b_n")), [*by, "b_id"], "left") \
        .join(shared, [*by, "a_id", "b_id"], "left").fillna(0, subset=["a_n", "b_n", "shared"])
    return _scored(sized, threshold).select(*by, "a_id", "b_id", "temporal_weight", "overlap", "score")


def components(pairs: DataFrame, a: str = "a_id", b: str = "b_id") -> DataFrame:
    """Connected components as (incident_id, component): component is the smallest incident id."""
    return connected_components(pairs, a, b).withColumnRenamed("node", "incident_id")


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def cascade_summary(inc: DataFrame, comp: DataFrame) -> DataFrame:
    """Root, path, severity mix and score of each cascade.

    ``inc`` carries incident_id, incident_type, detected_at, severity and
    evidence_event_count. The path keeps every incident in time order; a
    cascade is bounded by the incidents of one linked period.
    """
    x = inc.join(comp, "incident_id").withColumn("_rank", F.element_at(_map(config.SEVERITY_RANK), F.col("severity"))) \
        .withColumn("_w", F.element_at(_map(config.SEVERITY_WEIGHT), F.col("severity")))
    g = x.groupBy("component").agg(
        F.min_by("incident_id", F.struct("detected_at", "incident_id")).alias("root_incident_id"),
        F.count("*").alias("total_incidents"), F.sum("evidence_event_count").alias("total_evidence_events"),
        F.array_sort(F.collect_list(F.struct("detected_at", "incident_id", "incident_type"))).alias("_p"),
        F.max_by("severity", "_rank").alias("max_severity"), F.avg("_w").alias("_avg"),
        *[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in config.SEVERITY_RANK])
    return g.select(
        F.concat(F.lit("cascade:"), "component").alias("cascade_id"), "root_incident_id", "total_incidents",
        "total_evidence_events", F.transform("_p", lambda p: p["incident_type"]).alias("cascade_path"),
        F.transform("_p", lambda p: p["incident_id"]).alias("incident_ids"), "max_severity",
        *[f"{s}_count" for s in config.SEVERITY_RANK],
        F.least(F.lit(1.0), 0.7 * F.col("_avg") + 0.3 * F.least(F.col("total_incidents") - 1, F.lit(4)) / 4.0)
        .alias("cascade_score"))


def distinct_evidence(inc: DataFrame, ev: DataFrame, comp: DataFrame, by: tuple[str, ...] = (), types: DataFrame | None = None) -> DataFrame:
    """Distinct evidence events per cascade.

    An event is evidence by its type and day, and every event id occurs once:
    the distinct (type, day) cells of a cascade, weighted with the daily event
    counts, give the number without touching an event.
    """
    cells = _windows(inc, by).join(comp, "incident_id").select(*by, "component", "event_type", "event_date").distinct()
    return cells.join(daily_type_counts(ev, by) if types is None else types, [*by, "event_type", "event_date"]) \
        .groupBy(*by, "component").agg(F.sum("n").alias("unique_evidence_entities"))


def recurring_patterns(inc: DataFrame, as_of: str | Column, lookback_days: int = 365) -> DataFrame:
    """Dominant month (else quarter) per incident type: at least 2 incidents and 40 % of them."""
    end = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    day = F.to_date("detected_at")
    x = inc.where((day >= F.date_sub(end, lookback_days)) & (day <= end)).select("incident_type", "detected_at")

    def share(period: Column) -> DataFrame:
        c = x.groupBy("incident_type", period.alias("p")).agg(F.count("*").alias("c"))
        return c.groupBy("incident_type").agg(
            F.max_by("p", F.struct("c", -F.col("p"))).alias("period"), F.max("c").alias("period_count"),
            F.sum("c").alias("occurrences"))

    month = share(F.month("detected_at")).select("incident_type", F.col("period").alias("m"), F.col("period_count").alias("mc"), "occurrences")
    quarter = share(F.quarter("detected_at")).select("incident_type", F.col("period").alias("q"), F.col("period_count").alias("qc"))
    j = month.join(quarter, "incident_type").where("occurrences >= 2")
    mp, qp = F.col("mc") * 100.0 / F.col("occurrences"), F.col("qc") * 100.0 / F.col("occurrences")
    use_m = (F.col("mc") >= 2) & (mp >= 40)
    use_q = ~use_m & (F.col("qc") >= 2) & (qp >= 40)
    pct = F.when(use_m, mp).otherwise(qp)
    return j.where(use_m | use_q).select(
        "incident_type", F.when(use_m, "month").otherwise("quarter").alias("period_kind"),
        F.when(use_m, F.col("m")).otherwise(F.col("q")).alias("period"),
        F.when(use_m, F.col("mc")).otherwise(F.col("qc")).alias("period_count"), "occurrences",
        F.when(pct >= 60, "high").otherwise("medium").alias("confidence"))


def compare_incidents(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Side-by-side comparison of incident pairs (a_id, b_id).

    ``facts`` has one row per incident: incident_id, severity, primary_zscore,
    causes (array of metric names), customers_affected, revenue_exposure.
    """
    def side(p: str) -> DataFrame:
        return facts.select(*[F.col(c).alias(f"{p}_{'id' if c == 'incident_id' else c}") for c in facts.columns])
    j = pairs.join(side("a"), "a_id").join(side("b"), "b_id")
    rank = _map(config.SEVERITY_RANK)
    ra, rb = F.element_at(rank, F.col("a_severity")), F.element_at(rank, F.col("b_severity"))

    def ratio(c: str, floor: float) -> Column:
        return F.col(f"a_{c}") / F.greatest(F.col(f"b_{c}"), F.lit(floor))
    return j.select(
        "a_id", "b_id",
        F.array_sort(F.array_intersect("a_causes", "b_causes")).alias("shared_causes"),
        F.array_sort(F.array_except("a_causes", "b_causes")).alias("only_a"),
        F.array_sort(F.array_except("b_causes", "a_causes")).alias("only_b"),
        F.when(ra > rb, "a_more_severe").when(ra < rb, "b_more_severe").otherwise("equal").alias("severity_relation"),
        (F.abs("a_primary_zscore") / F.greatest(F.abs("b_primary_zscore"), F.lit(0.001))).alias("zscore_ratio"),
        ratio("customers_affected", 1.0).alias("customer_ratio"), ratio("revenue_exposure", 0.01).alias("revenue_ratio"))


def compare_significance(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Two-sided z-test on the difference of absolute z-scores (SE sqrt 2) and relative effect size."""
    a, b = F.abs("a_zscore"), F.abs("b_zscore")
    stat = F.abs(a - b) / math.sqrt(2.0)
    mean = (a + b) / 2.0
    p = erfc(stat / math.sqrt(2.0))
    return pairs.withColumn("z_statistic", stat).withColumn("p_value", p) \
        .withColumn("significant", p < alpha) \
        .withColumn("effect_size", F.abs(a - b) / F.greatest(mean, F.lit(0.001)))
