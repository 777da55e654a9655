"""Impact of incidents: affected entities, exposure, severity, reach and graph edges.

Incident windows end on a day and have a fixed length, so impact figures are
trailing-window values per day. They are computed once per day from daily
sums and start/end deltas and joined to the incidents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwise import config
from panelwise.operators.daily import _running_on_spine, related_to, total_of, type_days
from panelwise.session import cut_lineage

LOOKBACK = 30
KINDS = ["customer", "order", "product", "vendor"]


def followups(inc: DataFrame, hours: int = 48) -> DataFrame:
    """Incidents detected within (0, hours) after each incident; day buckets keep the join an equi join."""
    reach = hours // 24 + 1
    a = inc.select("incident_id", F.col("detected_at").alias("a_at"), F.explode(F.sequence(
        F.to_date("detected_at"), F.date_add(F.to_date("detected_at"), reach), F.expr("interval 1 day"))).alias("_d"))
    b = inc.select(F.col("incident_id").alias("followup_id"), F.col("detected_at").alias("b_at"), F.to_date("detected_at").alias("_d"))
    gap = F.unix_micros("b_at") - F.unix_micros("a_at")
    return a.join(b, "_d").where((gap > 0) & (gap < hours * 3_600_000_000)).select("incident_id", "followup_id")


def entity_days(ev: DataFrame) -> DataFrame:
    """Distinct (kind, entity, day) seen as the event's entity or among its related entities."""
    return _entity_rows(ev).groupBy("kind", "entity", "metric_date").agg(F.lit(1).alias("_one"))


def _entity_rows(ev: DataFrame) -> DataFrame:
    """(metric_date, kind, entity) for the entity of every event and each of its related entities.

    Where all related entities have columns, no map is built or taken apart.
    """
    day = F.to_date("event_time").alias("metric_date")
    if all(f"related_{k}" in ev.columns for k in KINDS):
        cells = [F.struct(F.col("entity_type").alias("kind"), F.col("entity_id").alias("entity"))]
        cells += [F.struct(F.lit(k).alias("kind"), related_to(ev, k).alias("entity")) for k in KINDS]
        return ev.select(day, F.inline(F.array(*cells))).where("entity is not null")
    own = F.array(F.struct(F.coalesce("entity_type", F.lit("")).alias("key"), F.col("entity_id").alias("value")))
    linked = F.map_entries(F.coalesce("related", F.create_map().cast("map<string,string>")))
    kind = F.when(F.col("pos") == 0, F.col("entity_type")).otherwise(F.lower("e.key"))
    return ev.select(day, "entity_type", F.posexplode(F.concat(own, linked)).alias("pos", "e")) \
        .select("metric_date", kind.alias("kind"), F.col("e.value").alias("entity")).where("entity is not null")


#: Days in a block of :func:`affected_by_day`: a window from any of its days ends in it or in the next one.
BLOCK = 62


def _active_blocks(seen: DataFrame, days: int) -> DataFrame:
    """(kind, entity, block, mask): bit i of the mask is set if the entity was seen in the ``days`` days up to day i of the block."""
    pos = F.pmod(F.unix_date("metric_date"), F.lit(BLOCK))
    window = F.lit((1 << days) - 1).cast("long")
    here = F.call_function("shiftleft", window, F.col("_pos")).bitwiseAND(F.lit((1 << BLOCK) - 1))
    over = F.when(F.col("_pos") + days > BLOCK, F.struct((F.col("_block") + 1).alias("block"), F.call_function("shiftright", window, F.lit(BLOCK) - F.col("_pos")).alias("mask")))
    at = seen.withColumn("_pos", pos).withColumn("_block", ((F.unix_date("metric_date") - F.col("_pos")) / BLOCK).cast("int"))
    return at.select("kind", "entity", F.inline(F.array(F.struct(F.col("_block").alias("block"), here.alias("mask")), over))) \
        .where("mask is not null").groupBy("kind", "entity", "block").agg(F.bit_or("mask").alias("mask"))


def affected_by_day(ev: DataFrame, spine: DataFrame, days: int = LOOKBACK + 1) -> DataFrame:
    """Distinct entities per kind in the trailing window (at most ``BLOCK`` days) of every spine day.

    An entity's active days are one long of bits per block, or'ed in one
    shuffle without sorting, and counted bit by bit. An entity that was also
    seen without a day counts from the beginning until its first day.
    """
    if not 0 < days <= BLOCK:
        raise ValueError(f"windows have 1 to {BLOCK} days")
    dated, undated = ev.where("event_time is not null"), ev.where("event_time is null")
    masks = _active_blocks(_entity_rows(dated).where(F.col("kind").isin(KINDS)), days)
    bits = masks.groupBy("kind", "block").agg(*[F.sum(F.shiftright("mask", i).bitwiseAND(F.lit(1))).alias(f"_{i}") for i in range(BLOCK)])
    counts = bits.select("kind", "block", F.posexplode(F.array(*[f"_{i}" for i in range(BLOCK)])).alias("_pos", "n")) \
        .select(F.date_from_unix_date(F.col("block") * BLOCK + F.col("_pos")).alias("metric_date"), "kind", "n") \
        .groupBy("metric_date").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"{k}s_affected") for k in KINDS])
    names = [f"{k}s_affected" for k in KINDS]
    found = spine.join(counts, "metric_date", "left").fillna(0, subset=names).where("metric_date is not null")
    lost = entity_days(undated).where(F.col("kind").isin(KINDS)).select("kind", "entity")
    if not lost.isEmpty():
        found = _with_undated(found, _entity_rows(dated).join(lost, ["kind", "entity"], "left_semi"), spine)
    return found.select("metric_date", *names)


def _with_undated(found: DataFrame, seen: DataFrame, spine: DataFrame) -> DataFrame:
    """Add the entities that were also seen without a day, each until its first day in ``seen``."""
    first = seen.groupBy("kind", "entity").agg(F.min("metric_date").alias("metric_date"))
    deltas = first.select("kind", F.inline(F.array(F.struct(F.lit(None).cast("date").alias("metric_date"), F.lit(1).alias("d")), F.struct("metric_date", F.lit(-1).alias("d"))))) \
        .groupBy("metric_date").agg(*[F.sum(F.when(F.col("kind") == k, F.col("d")).otherwise(0)).alias(k) for k in KINDS])
    early = _running_on_spine(deltas, spine, (), {k: f"_{k}" for k in KINDS})
    return found.join(early, "metric_date", "left").select("metric_date", *[(F.col(f"{k}s_affected") + F.coalesce(f"_{k}", F.lit(0))).alias(f"{k}s_affected") for k in KINDS])


def affected_entities(inc: DataFrame, ev: DataFrame, spine: DataFrame) -> DataFrame:
    return inc.select("incident_id", F.col("window_end").alias("metric_date")).join(affected_by_day(ev, spine), "metric_date").drop("metric_date")


def impact(inc: DataFrame, ev: DataFrame, spine: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Exposure figures of each incident's trailing window; ``types`` are the events' ``type_days`` where they are there already."""
    revenue, refunds, orders = ["invoice_paid", "payment_received", "invoice_issued"], ["refund_issued", "credit_memo_issued"], ["order_placed", "invoice_issued"]
    daily = (type_days(ev) if types is None else types).groupBy(F.col("event_date").alias("metric_date")).agg(
        total_of(revenue).alias("rev"), total_of(refunds).alias("ref"), F.coalesce(F.sum("amount_sum"), F.lit(0.0)).alias("all"),
        total_of(orders).alias("ord"), F.sum(F.when(F.col("event_type").isin(orders), F.col("amount_n"))).alias("ord_n"))
    w = W.partitionBy().orderBy(F.unix_date("metric_date")).rangeBetween(-LOOKBACK, 0)  # one row per calendar day
    rolled = spine.join(daily, "metric_date", "left").fillna(0).select(
        "metric_date", F.sum("rev").over(w).alias("revenue_exposure"), F.sum("ref").over(w).alias("refund_exposure"),
        F.sum("all").over(w).alias("total_event_amount"), F.coalesce(F.try_divide(F.sum("ord").over(w), F.sum("ord_n").over(w)), F.lit(0.0)).alias("avg_order_value"))
    factor = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in config.CHURN_RISK_FACTOR.items() for x in kv]), F.col("incident_type")), F.lit(1.0))
    return inc.select("incident_id", "incident_type", F.col("window_end").alias("metric_date")).join(rolled, "metric_date") \
        .join(affected_entities(inc, ev, spine), "incident_id") \
        .withColumn("churn_exposure", F.floor(F.col("customers_affected") * config.CHURN_RISK * factor)).drop("metric_date")


def blast_severity(impacts: DataFrame, follow: DataFrame) -> DataFrame:
    """Highest rung of the ladder reached by any figure."""
    n = follow.groupBy("incident_id").agg(F.count("*").alias("downstream_count"))
    x = impacts.join(n, "incident_id", "left").fillna(0, subset=["downstream_count"])
    level = None
    for name, customers, revenue, refunds, downstream in config.BLAST_LADDER:
        hit = (F.col("customers_affected") >= customers) | (F.col("revenue_exposure") >= revenue) | (F.col("refund_exposure") >= refunds) \
            | (F.col("downstream_count") >= downstream)
        level = F.when(hit, name) if level is None else level.when(hit, name)
    return x.withColumn("blast_severity", level.otherwise("contained"))


def entity_edges(ev: DataFrame) -> DataFrame:
    """Undirected co-occurrence edges between an event's entity and its related entities."""
    e = ev.where("related is not null").select(F.col("entity_id").alias("a"), F.explode(F.map_values("related")).alias("b")).where("a <> b and b is not null")
    return e.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).distinct()


def entity_reach(ev: DataFrame, seeds: DataFrame, depth: int = 5) -> DataFrame:
    """Entities within ``depth`` hops of each seed (seed, entity, hops); only the frontier is expanded."""
    edges = cut_lineage(entity_edges(ev))
    reached = cut_lineage(seeds.select("seed", F.col("seed").alias("entity"), F.lit(0).alias("hops")))
    front = reached
    for hop in range(1, depth + 1):
        front = front.join(edges, F.col("entity") == F.col("a")).select("seed", F.col("b").alias("entity")).distinct() \
            .join(reached, ["seed", "entity"], "left_anti").withColumn("hops", F.lit(hop))
        front = cut_lineage(front)
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached


def blast_edges(inc: DataFrame, ev: DataFrame) -> DataFrame:
    """(source, target, relation) rows for a graph view: incident -> entity and entity -> related entity."""
    kinds = F.create_map(*[x for k, v in config.EVIDENCE_EVENTS.items() for x in (F.lit(k), F.array(*[F.lit(e) for e in v]))])
    w = inc.select("incident_id", "metric_date", F.explode(F.element_at(kinds, F.col("incident_type"))).alias("event_type"))
    e = ev.select("event_type", F.to_date("event_time").alias("metric_date"), "entity_id", "related")
    hit = w.join(e, ["event_type", "metric_date"])
    cells = F.concat(F.array(F.struct(F.col("incident_id").alias("source"), F.col("entity_id").alias("target"), F.lit("affects").alias("relation"))),
                     F.transform(F.map_entries(F.coalesce("related", F.create_map().cast("map<string,string>"))), lambda x: F.struct(
                         F.col("entity_id").alias("source"), x["value"].alias("target"), x["key"].alias("relation"))))
    return hit.select(F.explode(cells).alias("c")).select("c.*").where("target is not null").distinct()
