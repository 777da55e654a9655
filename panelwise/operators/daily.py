"""Silver events -> daily gold metrics.

One conditional hash aggregate per day (partial aggregation on the map side),
then bounded windows over the resulting daily table. Per-customer metrics never
expand a customer to every day of a window: they use start/end deltas.

``by`` names optional series columns (for example a region); the default is one
series for the whole event table, whose daily table is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwise import config
from panelwise.functions.stats import safe_divide
from panelwise.session import written

ROUNDING = 6
EXACT = "decimal(38,6)"


#: Attributes that daily figures need, by their sum and their number.
MEASURED = ("days_to_pay", "balance_remaining", "days_late", "days_delayed", "resolution_time_hours", "score")


def type_days(ev: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Events per type and day with the sums behind all daily figures: one pass over the events, a table of types x days."""
    attributes = [f(f"attributes.{name}").alias(f"{name}_{what}") for name in MEASURED for f, what in ((F.sum, "sum"), (F.count, "n"))]
    return ev.groupBy(*by, "event_type", F.to_date("event_time").alias("event_date")).agg(
        F.count("*").alias("n"), F.sum("amount").alias("amount_sum"), F.count("amount").alias("amount_n"), *attributes)


def total_of(kinds: list[str], name: str = "amount_sum") -> Column:
    """Sum of a column of :func:`type_days` over event types, 0.0 without any."""
    return F.coalesce(F.sum(_of(kinds, name)), F.lit(0.0))


def _of(kinds: list[str], name: str) -> Column:
    return F.when(F.col("event_type").isin(kinds), F.col(name))


def _count(kind: str, name: str = "n") -> Column:
    return F.coalesce(F.sum(_of([kind], name)), F.lit(0))


def _mean(kind: str, name: str) -> Column:
    return F.try_divide(F.sum(_of([kind], f"{name}_sum")), F.sum(_of([kind], f"{name}_n")))


REVENUE = ["invoice_paid", "payment_received"]
REFUNDS = ["refund_issued", "credit_memo_issued"]


def daily_base(ev: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sums and counts per day; everything else is derived from this small table."""
    return daily_of(type_days(ev, by), by)


def daily_of(types: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """:func:`daily_base` from the table of :func:`type_days`."""
    return types.groupBy(*by, F.col("event_date").alias("metric_date")).agg(
        total_of(REVENUE).alias("revenue"),
        total_of(["expense_posted"]).alias("expenses"),
        total_of(REFUNDS).alias("refunds"),
        F.sum(_of(["invoice_paid"], "days_to_pay_sum")).alias("pay_days"),
        _count("invoice_paid", "days_to_pay_n").alias("pay_n"),
        total_of(["invoice_overdue"], "balance_remaining_sum").alias("overdue_amount"),
        _count("invoice_overdue").alias("overdue_n"),
        _count("expense_paid").alias("expense_paid_n"),
        _count("order_placed").alias("placed"),
        _count("order_delivered").alias("delivered"),
        _count("order_late").alias("late"),
        _mean("order_late", "days_late").alias("late_days"),
        _count("purchase_order_placed").alias("po"),
        _count("shipment_delayed").alias("delayed"),
        _mean("shipment_delayed", "days_delayed").alias("delayed_days"),
        _count("support_ticket_opened").alias("opened"),
        _count("support_ticket_closed").alias("closed"),
        _mean("support_ticket_closed", "resolution_time_hours").alias("resolution_hours"),
        F.sum(_of(["review_submitted"], "score_sum")).alias("score_sum"),
        _count("review_submitted", "score_n").alias("score_n"),
        _count("customer_churned").alias("churned"),
    )


def date_spine(daily: DataFrame, by: tuple[str, ...] = (), lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Every calendar day between the first and last day of each series."""
    bounds = daily.groupBy(*by).agg(F.min("metric_date").alias("_min"), F.max("metric_date").alias("_max")) \
        .withColumn("_a", F.lit(lo).cast("date") if lo else F.col("_min")) \
        .withColumn("_b", F.lit(hi).cast("date") if hi else F.col("_max"))
    return bounds.where("_a is not null").select(
        *by, F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias("metric_date"))


def on_spine(daily: DataFrame, by: tuple[str, ...] = (), lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Daily sums and counts on every calendar day (0 where nothing happened)."""
    keys = [*by, "metric_date"]
    zero_filled = [c for c in daily.columns
                   if c not in keys and c not in ("late_days", "delayed_days", "resolution_hours")]
    return date_spine(daily, by, lo, hi).join(daily, keys, "left").fillna(0, subset=zero_filled)


def _trailing(by: tuple[str, ...], days: int):
    return W.partitionBy(*by).orderBy(F.unix_date("metric_date")).rangeBetween(-(days - 1), 0)


def rolling_metrics(spined: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """All metrics that follow from the daily table by trailing windows."""
    w7, w14, w30 = (_trailing(by, n) for n in (7, 14, 30))

    def roll(name: str, w) -> Column:
        return F.sum(name).over(w)

    rev7, ref7, exp7 = roll("revenue", w7), roll("refunds", w7), roll("expenses", w7)
    return spined.select(
        *by, "metric_date",
        F.col("revenue").alias("daily_revenue"),
        F.col("expenses").alias("daily_expenses"),
        F.col("refunds").alias("daily_refunds"),
        safe_divide(ref7, rev7).alias("refund_rate"),
        (roll("revenue", w30) - roll("expenses", w30) - roll("refunds", w30)).alias("net_cash_proxy"),
        safe_divide(exp7, rev7).alias("expense_ratio"),
        safe_divide(rev7 - exp7 - ref7, rev7).alias("margin_proxy"),
        F.try_divide(roll("pay_days", w30), roll("pay_n", w30)).alias("dso_proxy"),
        F.col("overdue_amount").alias("ar_aging_amount"),
        F.col("overdue_n").alias("ar_overdue_count"),
        F.when(roll("expense_paid_n", w30) > 0, 30.0).otherwise(0.0).alias("dpo_proxy"),
        F.col("placed").alias("order_volume"),
        F.col("delivered").alias("delivery_count"),
        F.col("late").alias("late_delivery_count"),
        safe_divide(roll("late", w7), roll("delivered", w7)).alias("delivery_delay_rate"),
        F.greatest(F.lit(0), roll("placed", w14) - roll("delivered", w14)).alias("fulfillment_backlog"),
        F.col("late_days").alias("avg_delivery_delay_days"),
        safe_divide(roll("delayed", w7), roll("po", w7)).alias("supplier_delay_rate"),
        F.col("delayed_days").alias("supplier_delay_severity"),
        F.col("opened").alias("ticket_volume"),
        F.col("closed").alias("ticket_close_volume"),
        F.greatest(F.lit(0), roll("opened", w14) - roll("closed", w14)).alias("ticket_backlog"),
        F.col("resolution_hours").alias("avg_resolution_time"),
        F.try_divide(roll("score_sum", w7), roll("score_n", w7)).alias("review_score_avg"),
        review_trend(by).alias("review_score_trend"),
        roll("churned", w30).alias("_churned_30d"),
    )


def review_trend(by: tuple[str, ...] = (), days: int = 14, start: float = 3.0) -> Column:
    """Least-squares slope of the last ``days`` daily mean scores.

    Gaps are filled forward inside each window only, starting from ``start``;
    days before the first spine day count as gaps.
    """
    w = W.partitionBy(*by).orderBy(F.unix_date("metric_date")).rowsBetween(-(days - 1), 0)
    window = F.collect_list(F.struct(F.try_divide("score_sum", "score_n").alias("v"))).over(w)
    missing = F.lit(days) - F.size(window)
    mean_x = (days - 1) / 2.0
    sxx = days * (days * days - 1) / 12.0
    zero = F.struct(missing.cast("int").alias("i"), F.lit(start).alias("last"),
                    (F.lit(start) * missing * (missing - 1) / 2.0 - F.lit(start) * mean_x * missing).alias("sxy"))

    def step(acc: Column, row: Column) -> Column:
        value = F.coalesce(row["v"], acc["last"])
        return F.struct((acc["i"] + 1).alias("i"), value.alias("last"),
                        (acc["sxy"] + (acc["i"] - mean_x) * value).alias("sxy"))

    return F.aggregate(window, zero, step, lambda acc: acc["sxy"] / sxx)


def related_to(ev: DataFrame, kind: str) -> Column:
    """The related entity of a kind: its own column where the view has one, else the entry of the map."""
    own = f"related_{kind}"
    return F.col(own) if own in ev.columns else F.element_at("related", F.lit(kind))


def customer_days(ev: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per customer and day with an event: the event entity when it is a customer, and the related customer.

    ``paid`` is the day's revenue of the related customer, null without any.
    Both customer metrics follow from this table, so events are read once for it.
    Where related customers have a column, branches of events without customers are never read.
    """
    related = related_to(ev, "customer")
    if "related_customer" in ev.columns:
        ev = ev.where(related.isNotNull() | (F.col("entity_type") == "customer"))
    revenue = F.when(F.col("event_type").isin(REVENUE) & (F.col("amount") != 0), F.col("amount").cast(EXACT))
    own = (F.col("entity_type") == "customer") & F.col("entity_id").isNotNull() & ~F.col("entity_id").eqNullSafe(related)
    each = F.array(F.struct(related.alias("customer"), revenue.alias("paid")),
                   F.when(own, F.struct(F.col("entity_id").alias("customer"), F.lit(None).cast(EXACT).alias("paid"))))
    return ev.select(*by, F.to_date("event_time").alias("metric_date"), F.inline(each)).where("customer IS NOT NULL") \
        .groupBy(*by, "customer", "metric_date").agg(F.sum("paid").cast(EXACT).alias("paid"))


def active_customers(people: DataFrame, spine: DataFrame, by: tuple[str, ...] = (), days: int = 30) -> DataFrame:
    """Distinct customers of :func:`customer_days` seen in the trailing window of every spine day.

    A customer counts from each sighting until the window ends or the next
    sighting starts: +1 on the first day, -1 on the day after the last one.
    A running sum over days replaces a distinct count over expanded rows.
    """
    w = W.partitionBy(*by, "customer").orderBy("metric_date")
    ends = F.least(F.date_add("metric_date", days),
                   F.coalesce(F.lead("metric_date").over(w), F.date_add("metric_date", days)))
    spans = people.withColumn("_end", ends)
    deltas = spans.select(*by, F.inline(F.array(
        F.struct(F.col("metric_date"), F.lit(1).alias("d")),
        F.struct(F.col("_end").alias("metric_date"), F.lit(-1).alias("d"))))) \
        .groupBy(*by, "metric_date").agg(F.sum("d").alias("d"))
    return _running_on_spine(deltas, spine, by, {"d": "active"})


def _running_on_spine(deltas: DataFrame, spine: DataFrame, by: tuple[str, ...], names: dict[str, str]) -> DataFrame:
    """Running sums of daily deltas, reported on the spine days only."""
    keys = [*by, "metric_date"]
    merged = deltas.join(spine.withColumn("_on", F.lit(True)), keys, "full")
    w = W.partitionBy(*by).orderBy("metric_date").rowsBetween(W.unboundedPreceding, 0)
    return merged.select(*keys, "_on", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n) for c, n in names.items()]) \
        .where("_on").drop("_on")


def churn_proxy(people: DataFrame, spine: DataFrame, churned: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """30-day churned events over distinct customers seen (at least 1)."""
    keys = [*by, "metric_date"]
    return active_customers(people, spine, by).join(churned, keys).select(
        *keys, safe_divide(F.col("_churned_30d"), F.greatest(F.col("active"), F.lit(1))).alias("churn_proxy"))


def concentration(people: DataFrame, spine: DataFrame, by: tuple[str, ...] = (), days: int = 30) -> DataFrame:
    """30-day revenue share of the top max(1, n div 10) customers, for every spine day.

    A customer's trailing revenue is constant between its change days, so it is
    held as spans. Span counts and sums per magnitude bucket come from daily
    deltas; only the bucket that contains the cut rank is ranked exactly.
    """
    keys = [*by, "metric_date"]
    per_day = people.where("paid is not null").select(*by, "customer", "metric_date", F.col("paid").alias("amount"))
    changes = per_day.select(*by, "customer", F.inline(F.array(
        F.struct(F.col("metric_date"), F.col("amount"), F.lit(1).alias("n")),
        F.struct(F.date_add("metric_date", days).alias("metric_date"), (-F.col("amount")).alias("amount"),
                 F.lit(-1).alias("n"))))) \
        .groupBy(*by, "customer", "metric_date").agg(F.sum("amount").alias("amount"), F.sum("n").alias("n"))
    w = W.partitionBy(*by, "customer").orderBy("metric_date")
    running = w.rowsBetween(W.unboundedPreceding, 0)
    spans = changes.select(
        *by, "customer", F.col("metric_date").alias("start"), F.lead("metric_date").over(w).alias("stop"),
        F.sum("amount").over(running).cast(EXACT).alias("amount"), F.sum("n").over(running).alias("n"),
    ).where("n > 0 and stop is not null").withColumn(
        "bucket", F.when(F.col("amount") > 0, F.floor(F.log2(F.col("amount").cast("double")) * 16)).otherwise(-100000))

    deltas = spans.select(*by, "bucket", F.inline(F.array(
        F.struct(F.col("start").alias("metric_date"), F.lit(1).alias("n"), F.col("amount")),
        F.struct(F.col("stop").alias("metric_date"), F.lit(-1).alias("n"), (-F.col("amount")).alias("amount"))))) \
        .groupBy(*by, "bucket", "metric_date").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"))
    wb = W.partitionBy(*by, "bucket").orderBy("metric_date")
    level = wb.rowsBetween(W.unboundedPreceding, 0)
    state = deltas.select(
        *by, "bucket", "metric_date", F.lead("metric_date").over(wb).alias("_next"),
        F.sum("n").over(level).alias("n"), F.sum("amount").over(level).alias("amount"),
    ).where("n > 0 and _next is not null").select(
        *by, "bucket", "n", "amount",
        F.explode(F.sequence("metric_date", F.date_sub("_next", 1), F.expr("interval 1 day"))).alias("metric_date"))
    wd = W.partitionBy(*keys)
    above = wd.orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1)
    ranked = state.select(
        *keys, "bucket", "n", "amount",
        F.sum("n").over(wd).alias("total_n"), F.sum("amount").over(wd).alias("total"),
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_above"),
        F.coalesce(F.sum("amount").over(above), F.lit(0)).alias("sum_above"),
    ).withColumn("take", F.greatest(F.lit(1), F.floor(F.col("total_n") / 10)))
    cut = ranked.where("n_above < take and take <= n_above + n")

    inside = spans.select(*by, "bucket", "amount", F.explode(F.sequence(
        F.col("start"), F.date_sub("stop", 1), F.expr("interval 1 day"))).alias("metric_date")) \
        .join(cut.select(*keys, "bucket"), [*keys, "bucket"]) \
        .groupBy(*keys, "amount").agg(F.count(F.lit(1)).alias("n"))
    before = wd.orderBy(F.desc("amount")).rowsBetween(W.unboundedPreceding, -1)
    part = inside.join(cut.select(*keys, (F.col("take") - F.col("n_above")).alias("need")), keys) \
        .withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))) \
        .groupBy(*keys).agg(F.sum(F.col("amount") * F.greatest(
            F.lit(0), F.least(F.col("n"), F.col("need") - F.col("_before")))).alias("partial"))
    share = cut.join(part, keys).select(*keys, safe_divide(F.col("sum_above") + F.col("partial"), F.col("total"))
                                        .alias("customer_concentration"))
    return spine.join(share, keys, "left").fillna(0.0, subset=["customer_concentration"])


def gold_wide(ev: DataFrame, by: tuple[str, ...] = (), lo: str | None = None, hi: str | None = None,
              digits: int = ROUNDING, types: DataFrame | None = None) -> DataFrame:
    """All 27 metrics, one row per series and calendar day.

    Events are read twice, for the daily and for the customer-day table; both
    are written and everything else is derived from them. A caller that holds
    the events' :func:`type_days` already passes them as ``types``.
    """
    keys = [*by, "metric_date"]
    daily = written(daily_base(ev, by) if types is None else daily_of(types, by), "daily")
    people = written(customer_days(ev, by), "customer-days")
    spined = on_spine(daily, by, lo, hi)
    rolled = rolling_metrics(spined, by)
    spine = spined.select(*keys)
    wide = rolled.join(churn_proxy(people, spine, rolled.select(*keys, "_churned_30d"), by), keys) \
        .join(concentration(people, spine, by), keys)
    return rounded(wide.select(*keys, *config.METRICS), digits)


def rounded(wide: DataFrame, digits: int = ROUNDING) -> DataFrame:
    return wide.select(*[
        F.round(F.col(c).cast("double"), digits).alias(c) if c in config.METRICS else F.col(c)
        for c in wide.columns])


def rolling_gold(ev: DataFrame, metrics: list[str], by: tuple[str, ...] = (), digits: int = ROUNDING,
                 types: DataFrame | None = None) -> DataFrame:
    """Only metrics that need no per-customer state; unused aggregates are pruned by the optimizer."""
    spined = on_spine(daily_base(ev, by) if types is None else daily_of(types, by), by)
    return rounded(rolling_metrics(spined, by).select(*by, "metric_date", *metrics), digits)


def to_long(wide: DataFrame, by: tuple[str, ...] = (), keep_nulls: bool = False) -> DataFrame:
    """(metric_date, metric_name, metric_value); NULL metrics are dropped unless asked for."""
    names = [c for c in wide.columns if c in config.METRICS]
    cast = wide.select(*by, "metric_date", *[F.col(c).cast("double").alias(c) for c in names])
    long = cast.unpivot([*by, "metric_date"], names, "metric_name", "metric_value")
    return long if keep_nulls else long.where("metric_value is not null")


def to_wide(gold: DataFrame, by: tuple[str, ...] = (), names: list[str] | None = None) -> DataFrame:
    return gold.groupBy(*by, "metric_date").pivot("metric_name", names or config.METRICS) \
        .agg(F.max("metric_value"))


def with_domain(gold: DataFrame) -> DataFrame:
    pairs = [F.lit(x) for kv in config.DOMAIN_OF.items() for x in kv]
    return gold.withColumn("domain", F.element_at(F.create_map(*pairs), F.col("metric_name")))


def domain_health(wide: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """healthy / degraded / critical per domain; the overall score is the worst domain."""
    out, scores = [], []
    for domain, rules in config.DOMAIN_THRESHOLDS.items():
        def hit(level: int) -> Column:
            parts = [F.coalesce(F.col(r[0]) < r[level] if r[1] else F.col(r[0]) > r[level], F.lit(False))
                     for r in rules if r[0] in wide.columns]
            cond = F.lit(False)
            for p in parts:
                cond = cond | p
            return cond
        status = F.when(hit(2), "critical").when(hit(3), "degraded").otherwise("healthy")
        pick = F.when(status == "critical", config.HEALTH_SCORES["critical"]) \
            .when(status == "degraded", config.HEALTH_SCORES["degraded"]).otherwise(config.HEALTH_SCORES["healthy"])
        out += [status.alias(f"{domain}_status"), pick.alias(f"{domain}_score")]
        scores.append(pick)
    overall = F.least(*scores)
    return wide.select(
        *by, "metric_date", *out, overall.alias("overall_score"),
        F.when(overall >= 0.8, "healthy").when(overall >= 0.6, "degraded").otherwise("critical").alias("overall_status"))
