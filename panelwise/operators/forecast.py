"""Trend warnings, cash runway, tax, receivables, period comparison and what-if scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwise import config
from panelwise.functions.stats import student_t_two_sided
from panelwise.operators.health import grade
from panelwise.session import literal_table

# --- metric -> (threshold, breach when below) (fixed values) -------------------
TREND_THRESHOLDS = [
    ("refund_rate", 0.08, False), ("delivery_delay_rate", 0.20, False), ("ticket_backlog", 40.0, False),
    ("review_score_avg", 3.0, True), ("margin_proxy", 0.15, True), ("churn_proxy", 0.05, False),
    ("fulfillment_backlog", 100.0, False), ("supplier_delay_rate", 0.20, False), ("net_cash_proxy", -5000.0, True),
]
# --- scenario incident thresholds: (incident, metric, threshold, below, severity) (fixed values)
SCENARIO_THRESHOLDS = [
    ("refund_spike", "refund_rate", 0.08, False, "high"), ("fulfillment_sla_degradation", "delivery_delay_rate", 0.20, False, "high"),
    ("support_load_surge", "ticket_backlog", 40.0, False, "medium"), ("customer_satisfaction_regression", "review_score_avg", 3.0, True, "medium"),
    ("margin_compression", "margin_proxy", 0.15, True, "high"), ("churn_acceleration", "churn_proxy", 0.05, False, "critical"),
]
SCENARIO_CASCADES = [
    ("refund_spike", "support_load_surge"), ("fulfillment_sla_degradation", "customer_satisfaction_regression"),
    ("support_load_surge", "churn_acceleration"), ("customer_satisfaction_regression", "churn_acceleration"),
]
HIGHER_IS_BETTER = ["daily_revenue", "margin_proxy", "order_volume", "review_score_avg", "net_cash_proxy"]
GRADES = ["A", "B+", "B", "B-", "C+", "C", "C-", "D", "F"]
ATTENUATION = 0.7
MAX_HOPS = 3


def _last_days(gold: DataFrame, as_of: str, days: int) -> DataFrame:
    end = F.lit(as_of).cast("date")
    return gold.where((F.col("metric_date") >= F.date_sub(end, days)) & (F.col("metric_date") <= end) & F.col("metric_value").isNotNull())


def trend_fit(gold: DataFrame, as_of: str, days: int = 14, ahead: int = 5, min_points: int = 5) -> DataFrame:
    """Least-squares line over the last days of each metric with its significance and projection."""
    w = W.partitionBy("metric_name").orderBy("metric_date")
    x = _last_days(gold, as_of, days).withColumn("x", (F.row_number().over(w) - 1).cast("double"))
    y = F.col("metric_value")
    f = x.groupBy("metric_name").agg(
        F.count("*").alias("n"), F.regr_slope(y, F.col("x")).alias("slope"), F.regr_intercept(y, F.col("x")).alias("intercept"),
        F.regr_r2(y, F.col("x")).alias("r2"), F.regr_sxx(y, F.col("x")).alias("sxx"), F.regr_syy(y, F.col("x")).alias("syy"),
        F.max_by("metric_value", "metric_date").alias("current_value"), F.min_by("metric_value", "metric_date").alias("first_value")) \
        .where(F.col("n") >= min_points)
    df = F.col("n") - 2
    se = F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.col("r2")) * F.col("syy") / df / F.col("sxx"))
    f = f.withColumn("r2", F.coalesce("r2", F.lit(0.0))).withColumn("std_err", se)
    t = F.try_divide("slope", "std_err")
    x_new = F.col("n") + ahead - 1
    spread = 1.96 * F.col("std_err") * F.sqrt(1 + 1.0 / F.col("n") + F.pow(x_new - (F.col("n") - 1) / 2.0, 2) / F.col("sxx"))
    projected = F.col("slope") * x_new + F.col("intercept")
    return f.withColumn("p_value", F.when(F.col("syy") == 0, 1.0).when(t.isNull(), 0.0).otherwise(student_t_two_sided(t, df.cast("int")))) \
        .withColumn("projected_value", projected).withColumn("projected_lower", projected - spread).withColumn("projected_upper", projected + spread) \
        .withColumn("baseline", (F.col("first_value") + F.col("current_value")) / 2).drop("syy", "sxx", "first_value")


def trend_warnings(gold: DataFrame, as_of: str, days: int = 14, ahead: int = 5, max_p: float = 0.05, min_slope: float = 0.01) -> DataFrame:
    """Metrics whose trend is significant and crosses their threshold the bad way within the projection."""
    table = literal_table(gold.sparkSession, TREND_THRESHOLDS, "metric_name string, threshold double, below boolean")
    fit = trend_fit(gold, as_of, days, ahead).join(F.broadcast(table), "metric_name")
    v, s, p, lim = F.col("current_value"), F.col("slope"), F.col("projected_value"), F.col("threshold")
    bad = F.when(F.col("below"), (s < 0) & (p < lim) & (v > lim)).otherwise((s > 0) & (p > lim) & (v < lim))
    return fit.where((F.col("p_value") < max_p) & bad & (F.abs(s) >= min_slope)) \
        .withColumn("days_to_threshold", (lim - v) / s)


def warning_severity(warnings: DataFrame) -> DataFrame:
    d = F.col("days_to_threshold")
    return warnings.withColumn("severity", F.when(d.isNull(), "medium").when(d <= 2, "critical").when(d <= 5, "high")
                               .when(d <= 10, "medium").otherwise("low"))


def lag_features(gold: DataFrame, lags: int = 14, ahead: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """The last values, 7- and 14-row mean and sample std, last difference, and the value ``ahead`` rows later."""
    o = W.partitionBy(*by, "metric_name").orderBy("metric_date")
    v = F.col("metric_value")

    def frame(n: int):
        return o.rowsBetween(-(n - 1), 0)
    g = gold.where("metric_value is not null").select(
        *by, "metric_name", "metric_date", v.alias("lag_0"), *[F.lag(v, i).over(o).alias(f"lag_{i}") for i in range(1, lags)],
        F.avg(v).over(frame(7)).alias("mean_7"), F.stddev_samp(v).over(frame(7)).alias("std_7"),
        F.avg(v).over(frame(14)).alias("mean_14"), F.stddev_samp(v).over(frame(14)).alias("std_14"),
        (v - F.lag(v).over(o)).alias("diff_1"), F.lead(v, ahead).over(o).alias("target"))
    return g.where(F.col(f"lag_{lags - 1}").isNotNull())


def future_score(health: DataFrame, warnings: DataFrame) -> DataFrame:
    """Projected score and grade under the most urgent warning.

    ``health`` is one row (overall_score, overall_grade); ``warnings`` comes
    from :func:`warning_severity` (at most one row per metric).
    """
    top = warnings.agg(F.min_by(F.struct("metric_name", "severity", "days_to_threshold"),
                                F.struct("days_to_threshold", "metric_name")).alias("w"), F.count("*").alias("warnings_count"))
    h = health.withColumn("w", top.select("w").scalar()).withColumn("warnings_count", top.select("warnings_count").scalar())
    drop = F.when(F.col("w.severity") == "critical", 15.0).when(F.col("w").isNotNull(), 10.0).otherwise(0.0)
    steps = F.when(F.col("w.severity") == "critical", 2).when(F.col("w.severity").isin("high", "medium"), 1).otherwise(0)
    scale = F.array(*[F.lit(g) for g in GRADES])
    at = F.array_position(F.transform(scale, lambda g: F.substring(g, 1, 1)), F.substring("overall_grade", 1, 1)).cast("int") - 1
    return h.select("overall_score", "overall_grade", F.greatest(F.lit(0.0), F.col("overall_score") - drop).alias("projected_score"),
                    F.when(steps > 0, F.get(scale, F.least(F.lit(len(GRADES) - 1), at + steps))).otherwise(F.col("overall_grade")).alias("projected_grade"),
                    F.col("w.metric_name").alias("top_metric"), F.col("w.severity").alias("top_severity"), "warnings_count")


def t_quantile_975(df: Column) -> Column:
    """Two-sided 95 % Student-t quantile for integer df, by bisection on the exact tail."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(0.0).alias("lo"), F.lit(20.0).alias("hi")),
        lambda acc, _: F.when(student_t_two_sided((acc["lo"] + acc["hi"]) / 2, df) > 0.05, F.struct(
            ((acc["lo"] + acc["hi"]) / 2).alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(
                acc["lo"].alias("lo"), ((acc["lo"] + acc["hi"]) / 2).alias("hi"))),
        lambda acc: (acc["lo"] + acc["hi"]) / 2)


def cash_runway(gold: DataFrame, as_of: str, days: int = 60) -> DataFrame:
    """Months of cash at the mean burn rate, with a 95 % t-interval on the burn; NULL when burn is not positive."""
    g = _last_days(gold, as_of, days)
    rev = F.max(F.when(F.col("metric_name") == "daily_revenue", F.col("metric_value")))
    exp = F.max(F.when(F.col("metric_name") == "daily_expenses", F.col("metric_value")))
    cash = F.max(F.when(F.col("metric_name") == "net_cash_proxy", F.col("metric_value")))
    daily = g.where(F.col("metric_name").isin("daily_revenue", "daily_expenses", "net_cash_proxy")).groupBy("metric_date").agg(
        (F.coalesce(exp, F.lit(0.0)) - F.coalesce(rev, F.lit(0.0))).alias("burn"), F.coalesce(cash, F.lit(0.0)).alias("cash"))
    s = daily.agg(F.avg("burn").alias("m"), F.stddev_pop("burn").alias("sd"), F.count("*").alias("data_points"),
                  F.max_by("cash", "metric_date").alias("net_cash"))
    half = F.when((F.col("data_points") >= 2) & (F.col("sd") > 0),
                  t_quantile_975((F.col("data_points") - 1).cast("int")) * F.col("sd") / F.sqrt(F.col("data_points").cast("double"))).otherwise(0.0)
    s = s.withColumn("monthly_burn", F.col("m") * 30).withColumn("burn_low", (F.col("m") - half) * 30).withColumn("burn_high", (F.col("m") + half) * 30)
    on = (F.col("monthly_burn") > 0) & (F.col("net_cash") > 0)
    return s.select(
        "net_cash", "monthly_burn", "burn_low", "burn_high", "data_points", (F.col("monthly_burn") <= 0).alias("runway_infinite"),
        F.when(on, F.col("net_cash") / F.col("monthly_burn")).alias("runway_months"),
        F.when(on & (F.col("burn_high") > 0), F.col("net_cash") / F.col("burn_high")).alias("runway_lower"),
        F.when(on & (F.col("burn_low") > 0), F.col("net_cash") / F.col("burn_low")).alias("runway_upper"))


def cash_curve(runway: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    """Month-start balances 0..months ahead for the mean, the low and the high burn; never below zero."""
    known = F.col("runway_lower").isNotNull() & F.col("runway_upper").isNotNull()
    best = F.when(known, F.col("burn_low")).otherwise(F.col("monthly_burn") * 0.8)
    worst = F.when(known, F.col("burn_high")).otherwise(F.col("monthly_burn") * 1.2)

    def left(burn: Column) -> Column:
        return F.greatest(F.lit(0.0), F.col("net_cash") - burn * F.col("i"))
    return runway.withColumn("best", best).withColumn("worst", worst).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(months)))).select(
        F.add_months(F.trunc(F.lit(as_of).cast("date"), "month"), F.col("i")).alias("month"), left(F.col("monthly_burn")).alias("cash_baseline"),
        left(F.col("best")).alias("cash_best"), left(F.col("worst")).alias("cash_worst"))


def expense_scenarios(runway: DataFrame, cuts: list[float]) -> DataFrame:
    """Runway after cutting expenses by each percentage (70 % of the burn counts as expenses)."""
    s = runway.withColumn("expense_cut_pct", F.explode(F.array(*[F.lit(float(c)) for c in cuts])))
    after = F.col("monthly_burn") * (1 - 0.7 * F.col("expense_cut_pct") / 100)
    s = s.withColumn("burn_after", after)
    months = F.when((F.col("burn_after") > 0) & (F.col("net_cash") > 0), F.col("net_cash") / F.col("burn_after"))
    return s.select("expense_cut_pct", F.col("monthly_burn").alias("burn_before"), "burn_after", "runway_months", months.alias("scenario_months"),
                    (F.col("burn_after") <= 0).alias("infinite_after"), (months - F.coalesce("runway_months", F.lit(0.0))).alias("improvement_months"))


def receivable_risk(ev: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Risk score of every open invoice from age, balance and the customer's payment history.

    ``ev`` rows carry entity_id, customer, event_type, event_time, amount,
    balance, days_overdue, due_date, days_to_pay.
    """
    end = F.lit(as_of).cast("date")
    x = ev.where((F.col("event_time") >= F.date_sub(end, days)) & (F.col("event_time") <= F.date_add(end, 1)))
    over = x.where("event_type = 'invoice_overdue'").groupBy("entity_id").agg(F.max_by(F.struct(
        "customer", F.coalesce("balance", "amount").alias("balance"), F.coalesce("days_overdue", F.lit(30.0)).alias("aging")), "event_time").alias("r")) \
        .select("entity_id", "r.*")
    issued = x.where("event_type = 'invoice_issued'").groupBy("entity_id").agg(F.min_by(F.struct(
        "customer", F.coalesce("balance", "amount").alias("balance"),
        F.greatest(F.lit(0), F.coalesce(F.datediff(end, "due_date"), F.lit(0))).cast("double").alias("aging")), "event_time").alias("r")) \
        .select("entity_id", "r.*").where("balance > 0").join(over, "entity_id", "left_anti")
    to_pay = F.coalesce("days_to_pay", F.lit(30.0))
    paid = x.where("event_type = 'invoice_paid' and customer is not null").groupBy("customer").agg(
        F.avg(to_pay).alias("dso"), F.count_if(to_pay > 30).alias("late"))
    open_invoices = over.unionByName(issued).where("balance > 0").join(paid, "customer", "left") \
        .withColumn("dso", F.coalesce("dso", F.lit(30.0))).withColumn("late", F.coalesce("late", F.lit(0)))
    aging = F.least(F.lit(90.0), F.col("aging") / 30 * 25)
    size = F.least(F.lit(30.0), F.log10(F.greatest(F.lit(1.0), F.col("balance") / 100)) * 10)
    history = F.least(F.lit(25.0), (F.col("dso") - 30) / 30 * 15 + F.col("late") * 5)
    score = F.least(F.lit(100.0), aging + size + history)
    factors = F.array_compact(F.array(
        F.when(F.col("aging") > 30, "overdue"), F.when(F.col("balance") > 5000, "high_balance"),
        F.when(F.col("dso") > 45, "slow_payer"), F.when(F.col("late") > 0, "late_history")))
    return open_invoices.withColumn("risk_score", score).select(
        "entity_id", "customer", "balance", "aging", "dso", "late", "risk_score",
        F.when(score < 25, "low").when(score < 50, "medium").when(score < 75, "high").otherwise("critical").alias("risk_bucket"),
        F.when(F.size(factors) == 0, F.array(F.lit("baseline"))).otherwise(factors).alias("factors"))


def collection_scenarios(runway: DataFrame, receivables: DataFrame, sizes: list[int]) -> DataFrame:
    """Runway after collecting the top receivables, for several list lengths at once."""
    top = receivables.orderBy(F.desc("risk_score"), F.desc("balance"), "entity_id").limit(max(sizes))
    # at most max(sizes) rows
    ranked = top.withColumn("_r", F.row_number().over(W.partitionBy().orderBy(F.desc("risk_score"), F.desc("balance"), "entity_id")))
    sums = ranked.agg(*[F.sum(F.when(F.col("_r") <= n, F.col("balance"))).alias(f"n{n}") for n in sizes])
    s = sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("top_n"), F.coalesce(F.col(f"n{n}"), F.lit(0.0)).alias("collected")) for n in sizes])))
    for c in ("net_cash", "monthly_burn", "runway_months"):
        s = s.withColumn(c, runway.select(c).scalar())
    months = F.when((F.col("monthly_burn") > 0) & (F.col("net_cash") + F.col("collected") > 0), (F.col("net_cash") + F.col("collected")) / F.col("monthly_burn"))
    return s.select("top_n", "collected", (F.col("net_cash") + F.col("collected")).alias("new_cash"), months.alias("scenario_months"),
                    (F.col("monthly_burn") <= 0).alias("infinite_after"), (months - F.coalesce("runway_months", F.lit(0.0))).alias("improvement_months"))


def tax_estimate(gold: DataFrame, as_of: str, rate: float = 0.25, days: int = 365) -> DataFrame:
    """Tax on revenue - expenses - refunds, with audit risk factors."""
    rate = max(0.0, min(1.0, rate))
    g = _last_days(gold, as_of, days)

    def m(name: str) -> Column:
        return F.max(F.when(F.col("metric_name") == name, F.col("metric_value"))).alias(name)
    names = ["daily_revenue", "daily_expenses", "daily_refunds", "margin_proxy"]
    daily = g.where(F.col("metric_name").isin([*names, "expense_ratio"])).groupBy("metric_date").agg(*[m(n) for n in names]) \
        .withColumn("_r", F.row_number().over(W.partitionBy().orderBy(F.desc("metric_date"))))  # at most days + 1 rows

    def total(c: str, lo: int = 0, hi: int = 10**6) -> Column:
        return F.coalesce(F.sum(F.when((F.col("_r") > lo) & (F.col("_r") <= hi), F.col(c))), F.lit(0.0))
    s = daily.agg(total("daily_revenue").alias("revenue"), total("daily_expenses").alias("expenses"), total("daily_refunds").alias("refunds"),
                  F.avg("margin_proxy").alias("margin"), F.count("*").alias("days_with_data"), total("daily_revenue", 0, 7).alias("rev7"),
                  total("daily_expenses", 0, 7).alias("exp7"), total("daily_revenue", 7, 14).alias("prior7"))
    income = F.col("revenue") - F.col("expenses") - F.col("refunds")
    factors = F.array_compact(F.array(
        F.when(F.col("days_with_data") < 7, "limited_history"),
        F.when(F.try_divide("exp7", "rev7") >= 0.95, "high_expense_ratio"),
        F.when((F.col("margin") < 0.05) & (F.col("revenue") > 10000), "low_margin"),
        F.when((F.col("days_with_data") >= 14) & (F.try_divide("rev7", "prior7") >= 2.0), "revenue_spike")))
    return s.select("revenue", "expenses", "refunds", income.alias("taxable_income"), F.when(income > 0, income * rate).otherwise(0.0).alias("estimated_tax"),
                    "days_with_data", factors.alias("audit_factors"),
                    F.when(F.size(factors) >= 2, "high").when(F.size(factors) == 1, "elevated").otherwise("low").alias("audit_risk"))


def _simple_health(name: Column, v: Column) -> Column:
    def floor0(x: Column) -> Column:
        return F.greatest(F.lit(0.0), x)
    return F.when(name == "refund_rate", floor0(100 - v * 500)).when(name.isin("expense_ratio", "churn_proxy"), floor0(100 - v * 200)) \
        .when(name == "dso_proxy", floor0(100 - v)).when(name == "delivery_delay_rate", floor0(100 - v * 250)) \
        .when(name == "ticket_backlog", floor0(100 - v / 2)).when(name.isin("margin_proxy", "review_score_avg"), F.least(F.lit(100.0), v * 25)) \
        .when(name.isin("daily_revenue", "net_cash_proxy"), F.least(F.lit(100.0), floor0(v / 500))).otherwise(50.0)


def period_compare(gold: DataFrame, as_of: str, unit: str = "month") -> DataFrame:
    """Mean of each metric in the running period against the previous whole period."""
    end = F.lit(as_of).cast("date")
    start = F.trunc(end, unit)
    before = F.add_months(start, -3 if unit == "quarter" else -1)
    now = F.col("metric_date") >= start
    g = gold.where((F.col("metric_date") >= before) & (F.col("metric_date") <= end) & F.col("metric_value").isNotNull())
    m = g.groupBy("metric_name").agg(F.avg(F.when(now, F.col("metric_value"))).alias("current"), F.avg(F.when(~now, F.col("metric_value"))).alias("previous"))
    change = F.try_divide((F.col("current") - F.col("previous")) * 100.0, F.abs("previous"))
    better = F.when(F.col("metric_name").isin(HIGHER_IS_BETTER), F.col("change_pct") > 0).otherwise(F.col("change_pct") < 0)
    return m.withColumn("change_pct", change).withColumn("improved", better)


def period_summary(gold: DataFrame, inc: DataFrame, as_of: str, unit: str = "month") -> DataFrame:
    """Simple health of both periods and their incident counts, one row."""
    end = F.lit(as_of).cast("date")
    start = F.trunc(end, unit)
    before = F.add_months(start, -3 if unit == "quarter" else -1)
    cmp = period_compare(gold, as_of, unit)
    h = cmp.agg(F.coalesce(F.avg(_simple_health(F.col("metric_name"), F.col("current"))), F.lit(50.0)).alias("health"),
                F.coalesce(F.avg(F.when(F.col("previous").isNotNull(), _simple_health(F.col("metric_name"), F.col("previous")))), F.lit(50.0)).alias("previous_health"))
    day = F.to_date("detected_at")
    n = inc.where((day >= before) & (day <= end)).agg(F.count_if(day >= start).alias("incidents"), F.count_if(day < start).alias("previous_incidents"))
    out = h.withColumn("incidents", n.select("incidents").scalar()).withColumn("previous_incidents", n.select("previous_incidents").scalar())
    change = F.coalesce(F.try_divide((F.col("health") - F.col("previous_health")) * 100.0, F.col("previous_health")), F.lit(0.0))
    return out.withColumn("health_change_pct", change).withColumn("trend", F.when(change > 1, "up").when(change < -1, "down").otherwise("flat"))


def propagate(scenarios: DataFrame, base: DataFrame) -> DataFrame:
    """Spread metric changes along the signed graph, breadth first, at most three hops.

    ``scenarios``: (scenario, metric_name, change_pct); ``base``: (metric_name,
    metric_value). A metric is expanded once, in the first round it is reached;
    within a round sources act in name order and later writes win. Scenarios
    are rows, so any number of them is spread in the same three joins.
    """
    edges = literal_table(base.sparkSession, config.SCENARIO_EDGES, "metric_name string, dst string, corr double")
    targets = edges.join(base.select(F.col("metric_name").alias("dst"), F.col("metric_value").alias("base")), "dst") \
        .groupBy("metric_name").agg(F.collect_list(F.struct("dst", "corr", "base")).alias("t")) \
        .agg(F.map_from_entries(F.collect_list(F.struct("metric_name", "t"))).alias("m"))  # one row, 14 edges
    state = scenarios.join(base, "metric_name").select(
        "scenario", "metric_name", F.col("metric_value").alias("base"), (F.col("metric_value") * (1 + F.col("change_pct") / 100.0)).alias("value"),
        F.lit(0).alias("depth")).withColumn("expanded", F.abs(F.col("value") - F.col("base")) <= 1e-6)
    for hop in range(MAX_HOPS):
        rel = (F.col("value") - F.col("base")) / F.col("base") * ATTENUATION ** (hop + 1)
        opens = ~F.col("expanded") & (F.col("base") != 0)
        reached = F.filter(F.transform(F.try_element_at(F.col("_edges"), F.col("metric_name")), lambda t: F.struct(
            t["dst"].alias("metric_name"), F.col("metric_name").alias("source"), t["base"].alias("base"),
            (t["base"] * (1 + rel * t["corr"])).alias("value"), F.lit(hop + 1).alias("depth"), (rel * t["corr"]).alias("change"))),
            lambda x: F.abs(x["change"]) > 0.01)
        own = F.struct("metric_name", F.lit(None).cast("string").alias("source"), "base", "value", "depth", F.lit(0.0).alias("change"))
        rows = state.withColumn("_edges", targets.scalar()).select("scenario", F.inline(F.concat(
            F.array(own), F.when(opens, F.coalesce(reached, F.array())).otherwise(F.array()))))
        pushed = F.max_by("value", "source")
        state = rows.groupBy("scenario", "metric_name").agg(
            F.first("base").alias("base"), F.coalesce(pushed, F.max("value")).alias("value"), F.min("depth").alias("depth"),
            F.bool_or(F.col("source").isNull()).alias("expanded"))
    return state.select("scenario", "metric_name", "base", F.col("value").alias("simulated"), "depth")


def full_scenario(propagated: DataFrame, base: DataFrame) -> DataFrame:
    """Every metric of every scenario; untouched metrics keep their base value."""
    # scenario ids and the 27 base metrics meet on a map, not on a cross join
    values = F.map_from_entries(F.collect_list(F.struct("metric_name", "metric_value")))
    names = propagated.select("scenario").distinct().withColumn("_all", base.agg(values.alias("m")).scalar())
    grid = names.select("scenario", F.explode("_all").alias("metric_name", "base"))
    return grid.join(propagated.drop("base"), ["scenario", "metric_name"], "left").select(
        "scenario", "metric_name", "base", F.coalesce("simulated", "base").alias("simulated"))


def scenario_incidents(full: DataFrame) -> DataFrame:
    table = literal_table(full.sparkSession, SCENARIO_THRESHOLDS, "incident_type string, metric_name string, threshold double, below boolean, severity string")
    return full.join(F.broadcast(table), "metric_name").where(
        F.when(F.col("below"), F.col("simulated") < F.col("threshold")).otherwise(F.col("simulated") > F.col("threshold")))


def scenario_cascades(triggered: DataFrame) -> DataFrame:
    pairs = F.broadcast(literal_table(triggered.sparkSession, SCENARIO_CASCADES, "incident_type string, effect string"))
    effects = triggered.select("scenario", F.col("incident_type").alias("effect"))
    return triggered.join(pairs, "incident_type").join(effects, ["scenario", "effect"]).select(
        "scenario", F.concat_ws(" -> ", "incident_type", "effect").alias("cascade"))


def scenario_health(full: DataFrame, score: DataFrame) -> DataFrame:
    """Health after degradation: rising rates cost up to 20 points each, falling quality up to 15."""
    rel = F.try_divide(F.col("simulated") - F.col("base"), F.col("base"))
    up = F.col("metric_name").isin("refund_rate", "delivery_delay_rate", "churn_proxy") & (F.col("base") > 0) & (rel > 0)
    down = F.col("metric_name").isin("margin_proxy", "review_score_avg") & (F.col("base") > 0) & (rel < 0)
    cost = F.when(up, F.least(F.lit(20.0), rel * 30)).when(down, F.least(F.lit(15.0), -rel * 25)).otherwise(0.0)
    return full.groupBy("scenario").agg(F.sum(cost).alias("degradation")).withColumn("current_score", score.scalar()).withColumn(
        "projected_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("current_score") - F.col("degradation")))) \
        .withColumn("projected_grade", grade(F.col("projected_score")))
