"""Daily metrics, domain health and the order panel."""

from pyspark.sql import functions as F

from checks.views import ACTIVITY, LEDGER, MONEY, ORDER, PANEL, SHIPMENT, SUPPORT, with_rolled, with_wide
from panelwise import config
from panelwise.operators import daily
from panelwise.session import cut_lineage
from panelwise.sources import star

QUERIES, SQL = {}, {}


def _day(df):
    return df.withColumn("metric_date", F.date_format("metric_date", "yyyy-MM-dd"))


def _rolled(name, view, events, metrics):
    QUERIES[name] = lambda s, d, view=view, metrics=metrics: _day(daily.rolling_gold(view(s, d), metrics))
    SQL[name] = (f"WITH {with_rolled(events)} SELECT strftime(d, '%Y-%m-%d') AS metric_date, "
                 f"{', '.join(metrics)} FROM rolled")


SHIPPING = f"{ORDER} UNION ALL {SHIPMENT}"


def _shipping(s, d):
    return star.order_events(s, d).unionByName(star.shipment_events(s, d))


def _supply(s, d):
    return star.ledger_events(s, d).unionByName(star.shipment_events(s, d))


_rolled("g1_daily_money", star.money_events, MONEY, ["daily_revenue", "daily_expenses", "daily_refunds"])
_rolled("g2_rolling_ratios", star.money_events, MONEY, ["refund_rate", "expense_ratio", "margin_proxy"])
_rolled("g3_net_cash", star.money_events, MONEY, ["net_cash_proxy"])
_rolled("g4_dso", star.order_events, ORDER, ["dso_proxy"])
_rolled("g5_ar_aging", star.order_events, ORDER, ["ar_aging_amount", "ar_overdue_count"])
_rolled("g6_dpo", star.ledger_events, LEDGER, ["dpo_proxy"])
_rolled("g7_order_counts", _shipping, SHIPPING, ["order_volume", "delivery_count", "late_delivery_count"])
_rolled("g8_delay_rates", _supply, f"{LEDGER} UNION ALL {SHIPMENT}", ["delivery_delay_rate", "supplier_delay_rate"])
_rolled("g9_backlogs", _shipping, SHIPPING, ["fulfillment_backlog"])
_rolled("g9_ticket_backlog", star.activity_events, ACTIVITY, ["ticket_backlog"])
_rolled("g10_attribute_means", star.shipment_events, SHIPMENT, ["avg_delivery_delay_days", "supplier_delay_severity"])
_rolled("g10_resolution_time", star.activity_events, ACTIVITY, ["avg_resolution_time"])
_rolled("g11_ticket_counts", star.activity_events, ACTIVITY, ["ticket_volume", "ticket_close_volume"])
_rolled("g12_review_avg", star.activity_events, ACTIVITY, ["review_score_avg"])

_WIDE_COLS = ", ".join(config.METRICS)


def _wide(name, view, events, cols):
    QUERIES[name] = lambda s, d: _day(daily.gold_wide(view(s, d)).select("metric_date", *cols))
    SQL[name] = (f"WITH {with_wide(events)} SELECT strftime(d, '%Y-%m-%d') AS metric_date, {', '.join(cols)} FROM wide")




def _trend(s, d):
    spined = daily.on_spine(daily.daily_base(star.support_panel_events(s, d)))
    return _day(spined.select("metric_date", F.round(daily.review_trend(), 6).alias("review_score_trend")))


def _churn(s, d):
    ev = star.order_panel_events(s, d)
    spined = daily.on_spine(cut_lineage(daily.daily_base(ev)))
    rolled = daily.rolling_metrics(spined).select("metric_date", "_churned_30d")
    out = daily.churn_proxy(daily.customer_days(ev), spined.select("metric_date"), rolled)
    return _day(daily.rounded(out))


def _conc(s, d):
    ev = star.order_events(s, d)
    spine = daily.date_spine(daily.daily_base(ev))
    return _day(daily.rounded(daily.concentration(daily.customer_days(ev), spine)))


for _name, _fn, _events, _col in [("g13_review_trend", _trend, SUPPORT, "review_score_trend"),
                                  ("g14_churn_proxy", _churn, PANEL, "churn_proxy"),
                                  ("g15_concentration", _conc, ORDER, "customer_concentration")]:
    QUERIES[_name] = _fn
    SQL[_name] = f"WITH {with_wide(_events)} SELECT strftime(d, '%Y-%m-%d') AS metric_date, {_col} FROM wide"
_wide("g_all_metrics_orders", star.order_panel_events, PANEL, config.METRICS)
_wide("g_all_metrics_activity", star.activity_events, ACTIVITY, config.METRICS)


def _long_back(s, d):
    wide = daily.gold_wide(star.activity_events(s, d))
    return daily.with_domain(daily.to_long(wide)).groupBy("domain", "metric_name").agg(
        F.count("*").alias("n"), F.round(F.sum("metric_value"), 4).alias("total"))


QUERIES["g16_long_form"] = _long_back
SQL["g16_long_form"] = f"""WITH {with_wide(ACTIVITY)},
long AS (UNPIVOT (SELECT * EXCLUDE (d) FROM wide) ON {_WIDE_COLS} INTO NAME metric_name VALUE v)
SELECT CASE WHEN metric_name IN ({', '.join(f"'{m}'" for m in config.FINANCIAL)}) THEN 'financial'
  WHEN metric_name IN ({', '.join(f"'{m}'" for m in config.OPERATIONAL)}) THEN 'operational' ELSE 'customer' END AS domain,
  metric_name, count(*) AS n, round(sum(v), 4) AS total FROM long GROUP BY 1, 2"""


def _pivoted(s, d):
    gold = daily.to_long(daily.rolling_gold(star.money_events(s, d), ["refund_rate", "margin_proxy", "dso_proxy"]))
    return _day(daily.to_wide(gold, names=["refund_rate", "margin_proxy", "dso_proxy"]))


QUERIES["g16_wide_form"] = _pivoted
SQL["g16_wide_form"] = (f"WITH {with_rolled(MONEY)} SELECT strftime(d, '%Y-%m-%d') AS metric_date, refund_rate, "
                        "margin_proxy, dso_proxy FROM rolled")
QUERIES["g17_domain_health"] = lambda s, d: _day(daily.domain_health(daily.gold_wide(star.order_panel_events(s, d))))
SQL["g17_domain_health"] = f"""WITH {with_wide(PANEL)}, st AS (SELECT d,
  CASE WHEN margin_proxy < .1 OR expense_ratio > .85 THEN 'critical' WHEN margin_proxy < .2 OR expense_ratio > .75
    THEN 'degraded' ELSE 'healthy' END AS financial_status,
  CASE WHEN delivery_delay_rate > .3 OR fulfillment_backlog > 100 THEN 'critical'
    WHEN delivery_delay_rate > .15 OR fulfillment_backlog > 50 THEN 'degraded' ELSE 'healthy' END AS operational_status,
  CASE WHEN coalesce(review_score_avg < 2.5, false) OR ticket_backlog > 50 THEN 'critical'
    WHEN coalesce(review_score_avg < 3.5, false) OR ticket_backlog > 25 THEN 'degraded' ELSE 'healthy' END AS customer_status
  FROM wide),
sc AS (SELECT *, {', '.join(f"CAST(CASE {x}_status WHEN 'critical' THEN .3 WHEN 'degraded' THEN .7 ELSE 1 END AS DOUBLE) AS {x}_score" for x in ('financial', 'operational', 'customer'))} FROM st)
SELECT strftime(d, '%Y-%m-%d') AS metric_date, * EXCLUDE (d),
  least(financial_score, operational_score, customer_score) AS overall_score,
  CASE WHEN least(financial_score, operational_score, customer_score) >= .8 THEN 'healthy'
    WHEN least(financial_score, operational_score, customer_score) >= .6 THEN 'degraded' ELSE 'critical' END AS overall_status
FROM sc"""
