"""SQL definitions of the domain views, written independently of the Spark code."""

_COLS = [
    ("customer", "VARCHAR"), ("vendor", "VARCHAR"), ("product", "VARCHAR"), ("ord", "VARCHAR"),
    ("amount", "DOUBLE"), ("days_to_pay", "DOUBLE"), ("balance", "DOUBLE"), ("balance_remaining", "DOUBLE"),
    ("days_overdue", "DOUBLE"), ("days_late", "DOUBLE"), ("days_delayed", "DOUBLE"),
    ("resolution_time_hours", "DOUBLE"), ("score", "DOUBLE"), ("due_date", "DATE"), ("original_due_date", "DATE"),
]


def _sel(kind, key, day, etype, eid, src, where="", **given):
    cols = ", ".join(f"CAST({given.get(n, 'NULL')} AS {t}) AS {n}" for n, t in _COLS)
    return (f"SELECT '{kind}:' || {key} AS event_id, '{kind}' AS event_type, {day} AS event_time, "
            f"CAST({day} AS DATE) AS d, '{etype}' AS entity_type, {eid} AS entity_id, {cols} FROM {src}"
            + (f" WHERE {where}" if where else ""))


_CUST = "'customer:shop:' || o_custkey"
_INV = "'invoice:shop:' || o_orderkey"
_DUE = "CAST(o_orderdate AS DATE) + 30"
ORDER = " UNION ALL ".join([
    _sel("order_placed", "o_orderkey", "o_orderdate", "order", "'order:shop:' || o_orderkey", "orders",
         amount="o_totalprice", customer=_CUST),
    _sel("invoice_issued", "o_orderkey", "o_orderdate", "invoice", _INV, "orders", amount="o_totalprice",
         customer=_CUST, due_date=_DUE, balance="CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice END"),
    _sel("invoice_paid", "o_orderkey", "o_orderdate", "invoice", _INV, "orders", "o_orderstatus = 'F'",
         amount="o_totalprice", customer=_CUST, days_to_pay="o_orderkey % 45 + 1"),
    _sel("invoice_overdue", "o_orderkey", "o_orderdate", "invoice", _INV, "orders", "o_orderstatus = 'O'",
         amount="o_totalprice", customer=_CUST, balance_remaining="o_totalprice", days_overdue="o_orderkey % 120",
         original_due_date=_DUE),
])
_LKEY = ("(l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || "
         "date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)))")
_VEN, _PROD, _LORD = "'vendor:shop:' || l_suppkey", "'product:shop:' || l_partkey", "'order:shop:' || l_orderkey"
LEDGER = " UNION ALL ".join([
    _sel("expense_posted", _LKEY, "l_shipdate", "expense", f"'expense:shop:' || {_LKEY}", "lineitem",
         amount="l_extendedprice * l_tax", vendor=_VEN),
    _sel("refund_issued", _LKEY, "l_shipdate", "payment", f"'payment:shop:' || {_LKEY}", "lineitem",
         "l_returnflag = 'R'", amount="l_extendedprice * (1 - l_discount)", product=_PROD, ord=_LORD),
    _sel("expense_paid", _LKEY, "l_shipdate", "expense", f"'expense:shop:' || {_LKEY}", "lineitem",
         "l_linestatus = 'F'", amount="l_extendedprice * l_tax", vendor=_VEN),
    _sel("purchase_order_placed", _LKEY, "l_shipdate", "order", _LORD, "lineitem", "l_linestatus = 'O'",
         amount="l_extendedprice", vendor=_VEN, product=_PROD),
])
_SHIP = ("(SELECT *, epoch(l_shipdate - o_orderdate) / 86400.0 AS taken FROM lineitem JOIN orders "
         "ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate)")
SHIPMENT = " UNION ALL ".join([
    _sel("order_delivered", _LKEY, "l_shipdate", "order", _LORD, _SHIP, customer=_CUST, product=_PROD),
    _sel("order_late", _LKEY, "l_shipdate", "order", _LORD, _SHIP, "taken > 60", customer=_CUST, product=_PROD,
         days_late="taken - 60"),
    _sel("shipment_delayed", _LKEY, "l_shipdate", "order", _LORD, _SHIP, "taken > 90", vendor=_VEN, customer=_CUST,
         days_delayed="taken - 90"),
])
_CDAY = "(CAST(DATE '1995-01-01' + CAST(c_custkey * 37 % 2400 AS INTEGER) AS TIMESTAMP))"
CHURN = _sel("customer_churned", "c_custkey", _CDAY, "customer", "'customer:shop:' || c_custkey", "customer",
             "c_acctbal < 0")
_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_ET = {"purchase": ("payment_received", "payment"), "error": ("support_ticket_opened", "ticket"),
       "click": ("support_ticket_closed", "ticket"), "signup": ("customer_created", "customer"),
       "view": ("review_submitted", "order")}
ACTIVITY = " UNION ALL ".join(
    _sel(kind, "event_id", "ts", etype,
         "'customer:app:' || user_id" if raw == "signup" else f"'{etype}:app:' || event_id", "events",
         f"event_type = '{raw}'", customer="'customer:app:' || user_id",
         **({"amount": "value"} if raw == "purchase" else {}),
         **({"resolution_time_hours": _K} if raw == "click" else {}),
         **({"score": f"1 + {_K} % 5"} if raw == "view" else {}))
    .replace(f"'{kind}:' || event_id AS event_id", "'app:' || event_id AS event_id")
    for raw, (kind, etype) in _ET.items())

_OCUST, _TICKET = "'customer:shop:' || o_custkey", "'ticket:shop:' || o_orderkey"
TICKETS = " UNION ALL ".join([
    _sel("support_ticket_opened", "o_orderkey", "o_orderdate", "ticket", _TICKET, "orders",
         "o_orderpriority IN ('1-URGENT', '2-HIGH')", customer=_OCUST),
    _sel("support_ticket_closed", "o_orderkey", "o_orderdate", "ticket", _TICKET, "orders", "o_orderpriority = '5-LOW'",
         customer=_OCUST, resolution_time_hours="o_orderkey % 72"),
    _sel("review_submitted", "o_orderkey", "o_orderdate", "order", "'order:shop:' || o_orderkey", "orders",
         "o_orderpriority = '3-MEDIUM'", customer=_OCUST, score="1 + o_custkey % 5")])
SUPPORT = " UNION ALL ".join([
    TICKETS,
    _sel("invoice_paid", "o_orderkey", "o_orderdate", "invoice", _INV, "orders", "o_orderstatus = 'F'",
         amount="o_totalprice", customer=_OCUST, days_to_pay="o_orderkey % 45 + 1"),
    CHURN])
MONEY = f"{ORDER} UNION ALL {LEDGER}"
PANEL = f"{ORDER} UNION ALL {LEDGER} UNION ALL {SHIPMENT} UNION ALL {CHURN}"
WHOLE = f"{PANEL} UNION ALL {TICKETS}"

_G = "coalesce(sum(CASE WHEN event_type IN ({k}) THEN {v} END), 0)"


def _s(kinds, v="amount"):
    return _G.format(k=", ".join(f"'{k}'" for k in kinds), v=v)


def _n(kind, v="1"):
    return f"count(CASE WHEN event_type = '{kind}' THEN {v} END)"


def _avg(kind, v):
    return f"avg(CASE WHEN event_type = '{kind}' THEN {v} END)"


DAILY = f"""daily0 AS (
  SELECT d, {_s(['invoice_paid', 'payment_received'])} AS revenue, {_s(['expense_posted'])} AS expenses,
    {_s(['refund_issued', 'credit_memo_issued'])} AS refunds,
    {_s(['invoice_paid'], 'days_to_pay')} AS pay_days, {_n('invoice_paid', 'days_to_pay')} AS pay_n,
    {_s(['invoice_overdue'], 'balance_remaining')} AS overdue_amount, {_n('invoice_overdue')} AS overdue_n,
    {_n('expense_paid')} AS expense_paid_n, {_n('order_placed')} AS placed, {_n('order_delivered')} AS delivered,
    {_n('order_late')} AS late, {_avg('order_late', 'days_late')} AS late_days,
    {_n('purchase_order_placed')} AS po, {_n('shipment_delayed')} AS delayed,
    {_avg('shipment_delayed', 'days_delayed')} AS delayed_days,
    {_n('support_ticket_opened')} AS opened, {_n('support_ticket_closed')} AS closed,
    {_avg('support_ticket_closed', 'resolution_time_hours')} AS resolution_hours,
    {_s(['review_submitted'], 'score')} AS score_sum, {_n('review_submitted', 'score')} AS score_n,
    {_n('customer_churned')} AS churned
  FROM ev GROUP BY d),
spine AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM daily0),
daily AS (
  SELECT s.d, coalesce(revenue, 0) AS revenue, coalesce(expenses, 0) AS expenses, coalesce(refunds, 0) AS refunds,
    coalesce(pay_days, 0) AS pay_days, coalesce(pay_n, 0) AS pay_n, coalesce(overdue_amount, 0) AS overdue_amount,
    coalesce(overdue_n, 0) AS overdue_n, coalesce(expense_paid_n, 0) AS expense_paid_n, coalesce(placed, 0) AS placed,
    coalesce(delivered, 0) AS delivered, coalesce(late, 0) AS late, late_days, coalesce(po, 0) AS po,
    coalesce(delayed, 0) AS delayed, delayed_days, coalesce(opened, 0) AS opened, coalesce(closed, 0) AS closed,
    resolution_hours, coalesce(score_sum, 0) AS score_sum, coalesce(score_n, 0) AS score_n,
    coalesce(churned, 0) AS churned
  FROM spine s LEFT JOIN daily0 USING (d))"""


def _r(col, n):
    return f"sum({col}) OVER (ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _div(a, b):
    return f"CASE WHEN ({b}) = 0 THEN 0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


ROLLED = f"""rolled AS (
  SELECT d, round(revenue, 6) AS daily_revenue, round(expenses, 6) AS daily_expenses, round(refunds, 6) AS daily_refunds,
    round({_div(_r('refunds', 7), _r('revenue', 7))}, 6) AS refund_rate,
    round({_r('revenue', 30)} - {_r('expenses', 30)} - {_r('refunds', 30)}, 6) AS net_cash_proxy,
    round({_div(_r('expenses', 7), _r('revenue', 7))}, 6) AS expense_ratio,
    round({_div(f"({_r('revenue', 7)} - {_r('expenses', 7)} - {_r('refunds', 7)})", _r('revenue', 7))}, 6) AS margin_proxy,
    round(CASE WHEN {_r('pay_n', 30)} > 0 THEN {_r('pay_days', 30)} / {_r('pay_n', 30)} END, 6) AS dso_proxy,
    round(overdue_amount, 6) AS ar_aging_amount, CAST(overdue_n AS DOUBLE) AS ar_overdue_count,
    CASE WHEN {_r('expense_paid_n', 30)} > 0 THEN 30.0 ELSE 0.0 END::DOUBLE AS dpo_proxy,
    placed::DOUBLE AS order_volume, delivered::DOUBLE AS delivery_count, late::DOUBLE AS late_delivery_count,
    round({_div(_r('late', 7), _r('delivered', 7))}, 6) AS delivery_delay_rate,
    greatest(0, {_r('placed', 14)} - {_r('delivered', 14)})::DOUBLE AS fulfillment_backlog,
    round(late_days, 6) AS avg_delivery_delay_days,
    round({_div(_r('delayed', 7), _r('po', 7))}, 6) AS supplier_delay_rate,
    round(delayed_days, 6) AS supplier_delay_severity,
    opened::DOUBLE AS ticket_volume, closed::DOUBLE AS ticket_close_volume,
    greatest(0, {_r('opened', 14)} - {_r('closed', 14)})::DOUBLE AS ticket_backlog,
    round(resolution_hours, 6) AS avg_resolution_time,
    round(CASE WHEN {_r('score_n', 7)} > 0 THEN {_r('score_sum', 7)} / {_r('score_n', 7)} END, 6) AS review_score_avg,
    {_r('churned', 30)} AS churned30
  FROM daily)"""

TREND = """cells AS (
  SELECT t.d AS t, i, x.score_sum / nullif(x.score_n, 0) AS a
  FROM daily t CROSS JOIN range(14) r(i) LEFT JOIN daily x ON x.d = t.d - 13 + CAST(i AS INTEGER)),
filled AS (SELECT t, i, coalesce(last_value(a IGNORE NULLS) OVER (PARTITION BY t ORDER BY i), 3.0) AS y FROM cells),
trend AS (SELECT t AS d, round(regr_slope(y, i), 6) AS review_score_trend FROM filled GROUP BY t)"""

CHURNED = """seen AS (
  SELECT DISTINCT d, c FROM (SELECT d, entity_id AS c FROM ev WHERE entity_type = 'customer'
    UNION ALL SELECT d, customer FROM ev WHERE customer IS NOT NULL)),
act AS (SELECT s.d, count(DISTINCT c) AS n FROM spine s LEFT JOIN seen e ON e.d BETWEEN s.d - 29 AND s.d GROUP BY s.d),
churn AS (SELECT d, round(CAST(churned30 AS DOUBLE) / greatest(n, 1), 6) AS churn_proxy FROM rolled JOIN act USING (d))"""

CONCENTRATED = """paid AS (
  SELECT d, customer AS c, sum(amount) AS a FROM ev
  WHERE event_type IN ('invoice_paid', 'payment_received') AND customer IS NOT NULL AND amount <> 0 GROUP BY 1, 2),
roll30 AS (SELECT s.d, c, sum(a) AS a FROM spine s JOIN paid p ON p.d BETWEEN s.d - 29 AND s.d GROUP BY 1, 2),
rk AS (SELECT d, a, row_number() OVER (PARTITION BY d ORDER BY a DESC) AS r, count(*) OVER (PARTITION BY d) AS n FROM roll30),
conc0 AS (SELECT d, sum(CASE WHEN r <= greatest(1, n // 10) THEN a ELSE 0 END) / sum(a) AS x FROM rk GROUP BY d),
conc AS (SELECT s.d, round(coalesce(x, 0), 6) AS customer_concentration FROM spine s LEFT JOIN conc0 USING (d))"""

WIDE = "wide AS (SELECT * EXCLUDE (churned30) FROM rolled JOIN trend USING (d) JOIN churn USING (d) JOIN conc USING (d))"


def with_rolled(events):
    """CTEs ev .. rolled for an event view."""
    return f"ev AS ({events}), {DAILY}, {ROLLED}"


def with_wide(events):
    return f"{with_rolled(events)}, {TREND}, {CHURNED}, {CONCENTRATED}, {WIDE}"
