"""End-to-end jobs: raw -> canonical -> gold, and gold -> incidents -> reports.

Each stage writes a table and the next one reads it back. A stage can be rerun
on its own, a lost executor costs only the running stage, and no stage repeats
the scan of the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise import config
from panelwise.operators import blast, cascades, causes, daily, detection, ensemble, incidents, quality, reports, silver


def _table(df: DataFrame, folder: str, name: str, by: str | None = None) -> DataFrame:
    path = f"{folder}/{name}"
    # rows of one folder are brought together first, so that tasks do not each write a file into every folder
    rows = df.repartition(by) if by else df
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def ingest_to_gold(bronze: DataFrame, as_of: str, folder: str) -> dict[str, DataFrame]:
    """Raw records to events, quality report and the daily metric table."""
    events = silver.to_silver(bronze, as_of).withColumn("event_date", F.to_date("event_time"))
    valid, rejected = quality.split_valid(events)
    ev = _table(valid, folder, "silver", "event_date")
    bad = _table(rejected.drop("event_date"), folder, "rejected")
    report = _table(quality.quality_report(quality.completeness(bronze), quality.with_scores(ev, as_of)), folder, "quality")
    wide = daily.gold_wide(_metric_view(ev))
    gold = _table(daily.to_long(wide, keep_nulls=True), folder, "gold", "metric_name")
    return {"silver": ev, "rejected": bad, "quality": report, "gold": gold}


def _metric_view(ev: DataFrame) -> DataFrame:
    """The attribute fields the metrics read."""
    names = ["days_to_pay", "balance_remaining", "days_late", "days_delayed", "resolution_time_hours", "score"]
    return ev.select("event_id", "event_type", "event_time", "entity_type", "entity_id", "related", "amount",
                     F.struct(*[F.col(f"attributes.{n}").alias(n) for n in names]).alias("attributes"))


def analyse(gold: DataFrame, events: DataFrame, folder: str, window_days: int = 1) -> dict[str, DataFrame]:
    """Incidents of every day with evidence, cascades, causes, blast radius and reports."""
    z = _table(detection.mad_zscore(gold), folder, "zscores")
    changes = _table(detection.break_flags(gold, detection.changepoints(gold)), folder, "changes")
    names = [m for m in config.METRICS if m in {r[0] for r in gold.select("metric_name").distinct().collect()}]
    wide = gold.groupBy("metric_date").pivot("metric_name", names).agg(F.first("metric_value")).fillna(0.0, subset=names)
    days = _table(ensemble.anomalous_days(wide, names), folder, "anomalous_days")
    inc = _table(incidents.incidents(z, ml=days, breaks=changes, window_days=window_days), folder, "incidents")
    counts = _table(incidents.evidence_counts(inc, events), folder, "evidence_counts")
    pairs = _table(cascades.cascade_pairs_from_events(inc, events), folder, "cascade_pairs")
    comp = cascades.components(pairs)
    summary = _table(cascades.cascade_summary(inc.join(counts, "incident_id"), comp), folder, "cascades")
    edges = causes.metric_edges(gold.sparkSession)
    cands = _table(causes.candidates(inc, gold, edges), folder, "candidates")
    ranked = _table(causes.root_causes(inc, cands, edges), folder, "causes")
    spine = gold.select("metric_date").distinct()
    hit = _table(blast.blast_severity(blast.impact(inc, events, spine), blast.followups(inc)), folder, "blast")
    done = _table(reports.postmortems(inc, ranked, hit), folder, "postmortems")
    return {"zscores": z, "anomalous_days": days, "incidents": inc, "evidence_counts": counts, "cascade_pairs": pairs, "cascades": summary, "candidates": cands,
            "causes": ranked, "blast": hit, "postmortems": done}
