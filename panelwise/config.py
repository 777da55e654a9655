"""Metric names, thresholds, rule tables and graphs.

Everything here is data that has to hold exactly these values for results to be
right; no logic lives in this module.
"""

# --- metric names per domain (fixed values) ---------------------------------
FINANCIAL = [
    "daily_revenue", "daily_expenses", "daily_refunds", "refund_rate", "net_cash_proxy",
    "expense_ratio", "margin_proxy", "dso_proxy", "ar_aging_amount", "ar_overdue_count", "dpo_proxy",
]
OPERATIONAL = [
    "order_volume", "delivery_count", "late_delivery_count", "delivery_delay_rate",
    "fulfillment_backlog", "avg_delivery_delay_days", "supplier_delay_rate", "supplier_delay_severity",
]
CUSTOMER = [
    "ticket_volume", "ticket_close_volume", "ticket_backlog", "avg_resolution_time",
    "review_score_avg", "review_score_trend", "churn_proxy", "customer_concentration",
]
METRICS = FINANCIAL + OPERATIONAL + CUSTOMER
DOMAIN_OF = {
    **{m: "financial" for m in FINANCIAL},
    **{m: "operational" for m in OPERATIONAL},
    **{m: "customer" for m in CUSTOMER},
}

# --- domain thresholds: (metric, lower_is_worse, critical, degraded) (fixed values)
DOMAIN_THRESHOLDS = {
    "financial": [("margin_proxy", True, 0.10, 0.20), ("expense_ratio", False, 0.85, 0.75)],
    "operational": [("delivery_delay_rate", False, 0.30, 0.15), ("fulfillment_backlog", False, 100.0, 50.0)],
    "customer": [("review_score_avg", True, 2.5, 3.5), ("ticket_backlog", False, 50.0, 25.0)],
}
HEALTH_SCORES = {"healthy": 1.0, "degraded": 0.7, "critical": 0.3}

# --- health score table (fixed values) ---------------------------------------
# domain, metric, weight, direction, healthy bound, critical bound
HEALTH_METRICS = [
    ("financial", "margin_proxy", 0.25, "higher", 0.15, 0.05),
    ("financial", "refund_rate", 0.20, "lower", 0.03, 0.10),
    ("financial", "net_cash_proxy", 0.20, "higher", 0.0, -10000.0),
    ("financial", "expense_ratio", 0.15, "lower", 0.70, 0.95),
    ("financial", "dso_proxy", 0.20, "lower", 30.0, 90.0),
    ("operational", "delivery_delay_rate", 0.25, "lower", 0.05, 0.20),
    ("operational", "fulfillment_backlog", 0.20, "lower", 50.0, 200.0),
    ("operational", "supplier_delay_rate", 0.20, "lower", 0.05, 0.20),
    ("operational", "order_volume", 0.15, "higher", 10.0, 1.0),
    ("operational", "avg_delivery_delay_days", 0.20, "lower", 2.0, 10.0),
    ("customer", "review_score_avg", 0.25, "higher", 4.0, 2.5),
    ("customer", "ticket_backlog", 0.20, "lower", 20.0, 100.0),
    ("customer", "churn_proxy", 0.25, "lower", 0.02, 0.10),
    ("customer", "avg_resolution_time", 0.15, "lower", 24.0, 96.0),
    ("customer", "review_score_trend", 0.15, "higher", -0.02, -0.20),
]
DOMAIN_WEIGHTS = {"financial": 0.40, "operational": 0.35, "customer": 0.25}

# --- incident types, evidence event types, cascade dependencies (fixed values)
INCIDENT_TYPES = [
    "refund_spike", "fulfillment_sla_degradation", "support_load_surge", "churn_acceleration",
    "margin_compression", "liquidity_crunch_risk", "supplier_dependency_failure",
    "customer_satisfaction_regression",
]
_MONEY_EVENTS = ["invoice_paid", "invoice_overdue", "expense_posted", "payment_received"]
EVIDENCE_EVENTS = {
    "refund_spike": ["refund_issued", "credit_memo_issued"],
    "fulfillment_sla_degradation": ["order_late", "order_placed", "order_delivered"],
    "support_load_surge": ["support_ticket_opened", "support_ticket_closed"],
    "churn_acceleration": ["customer_churned"],
    "margin_compression": _MONEY_EVENTS,
    "liquidity_crunch_risk": _MONEY_EVENTS,
    "supplier_dependency_failure": ["shipment_delayed", "purchase_order_placed"],
    "customer_satisfaction_regression": ["review_submitted"],
}
CASCADE_EDGES = [
    ("fulfillment_sla_degradation", "support_load_surge"),
    ("fulfillment_sla_degradation", "customer_satisfaction_regression"),
    ("support_load_surge", "customer_satisfaction_regression"),
    ("support_load_surge", "churn_acceleration"),
    ("customer_satisfaction_regression", "churn_acceleration"),
    ("supplier_dependency_failure", "fulfillment_sla_degradation"),
    ("refund_spike", "margin_compression"),
    ("margin_compression", "liquidity_crunch_risk"),
    ("churn_acceleration", "margin_compression"),
]
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
SEVERITY_WEIGHT = {"low": 0.25, "medium": 0.50, "high": 0.75, "critical": 1.0}

# --- metric dependency graph: (upstream, downstream) (fixed values) ---------
METRIC_EDGES = [
    ("supplier_delay_rate", "delivery_delay_rate"),
    ("supplier_delay_rate", "fulfillment_backlog"),
    ("order_volume", "fulfillment_backlog"),
    ("fulfillment_backlog", "delivery_delay_rate"),
    ("delivery_delay_rate", "ticket_volume"),
    ("delivery_delay_rate", "review_score_avg"),
    ("ticket_volume", "ticket_backlog"),
    ("ticket_backlog", "avg_resolution_time"),
    ("avg_resolution_time", "review_score_avg"),
    ("review_score_avg", "churn_proxy"),
    ("ticket_volume", "churn_proxy"),
    ("churn_proxy", "daily_revenue"),
    ("refund_rate", "margin_proxy"),
    ("refund_rate", "daily_revenue"),
    ("daily_revenue", "margin_proxy"),
    ("daily_expenses", "expense_ratio"),
    ("expense_ratio", "margin_proxy"),
    ("margin_proxy", "net_cash_proxy"),
    ("dso_proxy", "ar_aging_amount"),
    ("ar_aging_amount", "net_cash_proxy"),
]

# --- signed what-if graph: (source, target, correlation) (fixed values) -----
SCENARIO_EDGES = [
    ("delivery_delay_rate", "refund_rate", 0.65),
    ("fulfillment_backlog", "delivery_delay_rate", 0.72),
    ("supplier_delay_rate", "delivery_delay_rate", 0.58),
    ("refund_rate", "ticket_volume", 0.78),
    ("refund_rate", "review_score_avg", -0.55),
    ("delivery_delay_rate", "ticket_volume", 0.68),
    ("delivery_delay_rate", "review_score_avg", -0.62),
    ("ticket_volume", "ticket_backlog", 0.85),
    ("ticket_backlog", "avg_resolution_time", 0.77),
    ("review_score_avg", "churn_proxy", -0.48),
    ("avg_resolution_time", "review_score_avg", -0.52),
    ("refund_rate", "margin_proxy", -0.73),
    ("expense_ratio", "margin_proxy", -0.88),
    ("churn_proxy", "daily_revenue", -0.42),
]

# --- payload fields each raw entity must carry (fixed values) ----------------
REQUIRED_FIELDS = {
    "Invoice": ["Id", "TxnDate", "TotalAmt", "CustomerRef"],
    "Payment": ["Id", "TxnDate", "TotalAmt", "CustomerRef"],
    "Bill": ["Id", "TxnDate", "TotalAmt", "VendorRef"],
    "BillPayment": ["Id", "TxnDate", "TotalAmt", "VendorRef"],
    "CreditMemo": ["Id", "TxnDate", "TotalAmt", "CustomerRef"],
    "RefundReceipt": ["Id", "TxnDate", "TotalAmt", "CustomerRef"],
    "Customer": ["Id", "DisplayName"],
    "PurchaseOrder": ["Id", "TxnDate", "VendorRef"],
}

# --- alert routing: severity -> (channels, escalation minutes) (fixed values)
ALERT_ROUTES = {
    "critical": (["pagerduty", "slack_critical", "email_oncall"], 15),
    "high": (["slack_alerts", "email_oncall"], 60),
    "medium": (["slack_alerts"], 240),
    "low": (["slack_info"], None),
}
SUPPRESSION_HOURS = 4

# --- root-cause score weights (fixed values) ---------------------------------
CAUSE_WEIGHTS = {"anomaly": 0.30, "temporal": 0.30, "proximity": 0.25, "quality": 0.15}

# --- incident type -> metric whose causes are searched (fixed values) ----------
INCIDENT_METRIC = {
    "refund_spike": "refund_rate",
    "fulfillment_sla_degradation": "delivery_delay_rate",
    "support_load_surge": "ticket_volume",
    "churn_acceleration": "churn_proxy",
    "margin_compression": "margin_proxy",
    "liquidity_crunch_risk": "net_cash_proxy",
    "supplier_dependency_failure": "supplier_delay_rate",
    "customer_satisfaction_regression": "review_score_avg",
}
# --- metric -> event types that explain it (fixed values) ------------------------
METRIC_EVENTS = {
    "refund_rate": ["refund_issued", "credit_memo_issued"],
    "daily_revenue": ["invoice_paid", "payment_received"],
    "daily_expenses": ["expense_posted"],
    "delivery_delay_rate": ["order_late"],
    "fulfillment_backlog": ["order_placed", "order_delivered"],
    "ticket_volume": ["support_ticket_opened"],
    "ticket_backlog": ["support_ticket_opened", "support_ticket_closed"],
    "review_score_avg": ["review_submitted"],
    "churn_proxy": ["customer_churned"],
    "supplier_delay_rate": ["shipment_delayed"],
    "margin_proxy": ["invoice_paid", "expense_posted", "refund_issued"],
}
# --- blast radius ladder: severity, customers, revenue, refunds, downstream (fixed values)
BLAST_LADDER = [
    ("catastrophic", 2000, 500000.0, 100000.0, 3),
    ("severe", 500, 100000.0, 25000.0, 2),
    ("significant", 50, 10000.0, 2000.0, 1),
]
CHURN_RISK = 0.06
CHURN_RISK_FACTOR = {"churn_acceleration": 2.0, "customer_satisfaction_regression": 2.0, "refund_spike": 1.5}
