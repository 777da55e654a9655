"""Sources, raw -> canonical transforms and data quality."""

from pyspark.sql import functions as F

from panelwise.operators import quality, silver
from panelwise.sources import raw, star
from panelwise.session import shared_folder, written
from checks.detect import INC_SELECT, inc_out, inc_sql, long_panel, panel_incidents
from checks.shared import keep
from checks.views import MONEY, _LKEY, with_rolled

QUERIES, SQL = {}, {}
AS_OF = "2001-12-31"


def ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _ev(df, *extra):
    return df.select("event_id", ts("event_time").alias("event_time"), "entity_id",
                     F.element_at("related", F.lit("customer")).alias("customer"), F.element_at("related", F.lit("vendor")).alias("vendor"),
                     "amount", F.concat_ws(",", "data_quality_flags").alias("flags"), *extra)


def _row(kind, key, time, eid, customer="NULL", vendor="NULL", amount="NULL", flags="''", **extra):
    cols = "".join(f", {v} AS {k}" for k, v in extra.items())
    return (f"SELECT '{kind}:acct:' || {key} AS event_id, strftime({time}, '%Y-%m-%d %H:%M:%S') AS event_time, '{eid}:acct:' || {key} AS entity_id, "
            f"CAST({customer} AS VARCHAR) AS customer, CAST({vendor} AS VARCHAR) AS vendor, CAST({amount} AS DOUBLE) AS amount, {flags} AS flags{cols}")


_OC = "CASE WHEN o_custkey % 50 <> 0 THEN 'customer:acct:' || o_custkey END"
_OF = "CASE WHEN o_custkey % 50 = 0 THEN 'missing_customer_ref' ELSE '' END"
_LV = "CASE WHEN l_suppkey % 25 <> 0 THEN 'vendor:acct:' || l_suppkey END"
_LF = "CASE WHEN l_suppkey % 25 = 0 THEN 'missing_vendor_ref' ELSE '' END"
_BAL = "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN o_totalprice / 2 ELSE o_totalprice END"
bronze = star.bronze_records
A = lambda n: F.col(f"attributes.{n}").alias(n)

QUERIES["t1_invoice_events"] = lambda s, d: _ev(silver.invoice_events(bronze(s, d), AS_OF), A("balance"), A("days_to_pay"), A("days_overdue"), A("balance_remaining"))
SQL["t1_invoice_events"] = f"""WITH o AS (SELECT *, {_BAL} AS bal, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 97 <> 0)
{_row('invoice_issued', 'o_orderkey', 'day', 'invoice', _OC, amount='o_totalprice', flags=_OF, balance='bal::DOUBLE', days_to_pay='NULL::DOUBLE', days_overdue='NULL::DOUBLE', balance_remaining='NULL::DOUBLE')} FROM o
UNION ALL {_row('invoice_paid', 'o_orderkey', 'day + CAST(o_orderkey % 45 + 1 AS INTEGER)', 'invoice', _OC, amount='o_totalprice', flags=_OF, balance='NULL', days_to_pay='o_orderkey % 45 + 1', days_overdue='NULL', balance_remaining='NULL')} FROM o WHERE bal = 0
UNION ALL {_row('invoice_overdue', 'o_orderkey', f"DATE '{AS_OF}'", 'invoice', _OC, amount='bal', flags=_OF, balance='NULL', days_to_pay='NULL', days_overdue=f"date_diff('day', day + 30, DATE '{AS_OF}')", balance_remaining='bal')} FROM o WHERE bal > 0 AND day + 30 < DATE '{AS_OF}'"""
QUERIES["t2_payment_events"] = lambda s, d: _ev(silver.payment_events(bronze(s, d), AS_OF), A("payment_method"),
                                               F.concat_ws(",", F.transform("attributes.linked", lambda x: x["id"])).alias("invoices"))
_OFFAMT = "CASE WHEN o_orderkey % 20 = 0 THEN o_totalprice - 1 ELSE o_totalprice END"
SQL["t2_payment_events"] = _row("payment_received", "('P' || o_orderkey)", "CAST(o_orderdate AS DATE) + 10", "payment", _OC, amount=_OFFAMT, flags=_OF,
                                payment_method="o_orderpriority", invoices="CAST(o_orderkey AS VARCHAR)") + " FROM orders WHERE o_orderstatus = 'F'"


def _line(name, fn, kind, prefix, eid, where, extra, sql_extra, party="vendor"):
    QUERIES[name] = lambda s, d: _ev(fn(bronze(s, d), AS_OF), *extra())
    who = dict(vendor=_LV, flags=_LF) if party == "vendor" else dict(customer="'customer:acct:' || l_partkey")
    SQL[name] = _row(kind, f"('{prefix}' || {_LKEY})", "CAST(l_shipdate AS DATE)", eid, amount="l_extendedprice", **who, **sql_extra) + f" FROM lineitem WHERE {where}"


_line("t3_bill_events", silver.bill_events, "expense_posted", "B", "expense", "true", lambda: [A("category")],
      {"category": "CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE '7' END"})
_line("t4_bill_payment_events", silver.bill_payment_events, "expense_paid", "BP", "expense", "l_linestatus = 'F'",
      lambda: [A("payment_method"), F.concat_ws(",", F.transform("attributes.linked", lambda x: x["id"])).alias("bills")],
      {"payment_method": "'Check'", "bills": f"'B' || {_LKEY}"})
_line("t5_credit_events", silver.credit_events, "credit_memo_issued", "CM", "invoice", "l_returnflag = 'A'", lambda: [A("reason")], {"reason": "l_linestatus"}, "customer")
_line("t5_refund_events", silver.refund_events, "refund_issued", "RR", "payment", "l_returnflag = 'R'", lambda: [A("payment_method")], {"payment_method": "'Card'"}, "customer")
_line("t7_purchase_order_events", silver.po_events, "purchase_order_placed", "PO", "order", "l_linestatus = 'O'", lambda: [A("expected_date")],
      {"expected_date": "strftime(CAST(l_shipdate AS DATE) + 7, '%Y-%m-%d')"})
QUERIES["t6_customer_events"] = lambda s, d: _ev(silver.customer_events(bronze(s, d), AS_OF), A("display_name"), A("balance"))
SQL["t6_customer_events"] = f"""WITH c AS (SELECT *, CASE c_custkey % 3 WHEN 1 THEN 'updated' ELSE 'created' END AS k,
  CASE c_custkey % 3 WHEN 0 THEN DATE '1994-01-01' WHEN 1 THEN DATE '1994-01-06' ELSE DATE '{AS_OF}' END AS at_ FROM customer)
SELECT 'customer_' || k || ':acct:' || c_custkey AS event_id, strftime(at_, '%Y-%m-%d %H:%M:%S') AS event_time, 'customer:acct:' || c_custkey AS entity_id,
  NULL::VARCHAR AS customer, NULL::VARCHAR AS vendor, NULL::DOUBLE AS amount, '' AS flags, c_name AS display_name, c_acctbal AS balance FROM c"""
QUERIES["t8_line_items"] = lambda s, d: silver.invoice_events(bronze(s, d), AS_OF).where("event_type = 'invoice_issued'") \
    .select("source_entity_id", F.posexplode("attributes.line_items").alias("pos", "x")).select("source_entity_id", "pos", "x.amount", "x.quantity", "x.item_id")
SQL["t8_line_items"] = """SELECT CAST(o_orderkey AS VARCHAR) AS source_entity_id, CAST(p AS INTEGER) AS pos, o_totalprice * CASE p WHEN 0 THEN 0.75::DOUBLE ELSE 0.25 END AS amount,
  1.0::DOUBLE AS quantity, CAST(o_custkey AS VARCHAR) AS item_id FROM orders, range(2) t(p) WHERE o_orderkey % 97 <> 0"""


def _silver_counts(s, d):
    b = bronze(s, d)
    made = silver.to_silver(b, AS_OF).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))
    lost = silver.skipped_records(b).select(F.concat_ws(":", "reason", "entity_type").alias("event_type"), F.col("records").alias("n"), F.lit(None).cast("double").alias("total"))
    return made.unionByName(lost)


QUERIES["t9_to_silver"] = _silver_counts
SQL["t9_to_silver"] = f"""WITH o AS (SELECT *, {_BAL} AS bal FROM orders WHERE o_orderkey % 97 <> 0), x AS (
SELECT 'invoice_issued' AS k, o_totalprice AS a FROM o UNION ALL SELECT 'invoice_paid', o_totalprice FROM o WHERE bal = 0
UNION ALL SELECT 'invoice_overdue', bal FROM o WHERE bal > 0 AND CAST(o_orderdate AS DATE) + 30 < DATE '{AS_OF}'
UNION ALL SELECT 'payment_received', {_OFFAMT} FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'expense_posted', l_extendedprice FROM lineitem
UNION ALL SELECT 'expense_paid', l_extendedprice FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT 'credit_memo_issued', l_extendedprice FROM lineitem WHERE l_returnflag = 'A'
UNION ALL SELECT 'refund_issued', l_extendedprice FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'purchase_order_placed', l_extendedprice FROM lineitem WHERE l_linestatus = 'O'
UNION ALL SELECT CASE c_custkey % 3 WHEN 1 THEN 'customer_updated' ELSE 'customer_created' END, NULL FROM customer
UNION ALL SELECT 'missing_id:Invoice', NULL FROM orders WHERE o_orderkey % 97 = 0 UNION ALL SELECT 'unknown_entity_type:Estimate', NULL FROM nation)
SELECT k AS event_type, count(*) AS n, round(sum(a), 2) AS total FROM x GROUP BY k"""


# --- file feeds -------------------------------------------------------------------
def order_files(s, d):
    """Order, item and review files with text columns, including blanks and bad values."""
    o, li = star.table(s, d, "orders"), star.table(s, d, "lineitem")
    orders = o.select(
        F.col("o_orderkey").cast("string").alias("order_id"), F.when(F.col("o_custkey") % 40 != 0, F.col("o_custkey").cast("string")).alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"),
        F.when(F.col("o_orderkey") % 61 != 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("not a date").alias("order_purchase_timestamp"),
        F.when(F.col("o_orderstatus") != "P", F.date_format(F.expr("o_orderdate + make_dt_interval(int(o_orderkey % 30), 6)"), "yyyy-MM-dd HH:mm:ss"))
        .otherwise(" ").alias("order_delivered_customer_date"),
        F.date_format(F.expr("o_orderdate + make_dt_interval(20)"), "yyyy-MM-dd HH:mm:ss").alias("order_estimated_delivery_date"))
    items = li.select(F.col("l_orderkey").cast("string").alias("order_id"), F.col("l_linenumber").alias("order_item_id"),
                      F.col("l_suppkey").cast("string").alias("seller_id"), F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("freight_value"))
    ev = star.table(s, d, "events").where("event_type = 'view'")
    reviews = ev.select(F.col("event_id").cast("string").alias("review_id"), F.col("user_id").cast("string").alias("order_id"),
                        F.get_json_object("props", "$.k").alias("review_score"), F.lit(None).cast("string").alias("review_comment_message"),
                        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("review_creation_date"))
    return orders, items, reviews


def _order_files(s, d):
    return silver.order_file_events(*order_files(s, d)).select(
        "event_id", ts("event_time").alias("event_time"), F.element_at("related", F.lit("customer")).alias("customer"),
        F.round("amount", 2).alias("amount"), F.round("attributes.days_late", 4).alias("days_late"), A("score"),
        F.concat_ws(",", "data_quality_flags").alias("flags"))


QUERIES["t10_order_file_events"] = _order_files
SQL["t10_order_file_events"] = """WITH t AS (SELECT l_orderkey, sum(l_extendedprice) + sum(l_tax) AS a FROM lineitem GROUP BY 1),
o AS (SELECT *, CASE WHEN o_custkey % 40 <> 0 THEN 'customer:orders_file:' || o_custkey END AS c, round(a, 2) AS amt,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER)) + INTERVAL 6 HOUR END AS del FROM orders LEFT JOIN t ON l_orderkey = o_orderkey WHERE o_orderkey % 61 <> 0)
SELECT 'order_placed:orders_file:' || o_orderkey AS event_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS event_time, c AS customer, amt AS amount, NULL::DOUBLE AS days_late, NULL::DOUBLE AS score,
  concat_ws(',', CASE WHEN c IS NULL THEN 'missing_customer_id' END, CASE WHEN amt IS NULL THEN 'missing_amount' END) AS flags FROM o
UNION ALL SELECT 'order_delivered:orders_file:' || o_orderkey, strftime(del, '%Y-%m-%d %H:%M:%S'), c, amt, NULL, NULL, '' FROM o WHERE del IS NOT NULL
UNION ALL SELECT 'order_late:orders_file:' || o_orderkey, strftime(del, '%Y-%m-%d %H:%M:%S'), c, amt, round(epoch(del - o_orderdate - INTERVAL 20 DAY) / 86400.0, 4), NULL, '' FROM o WHERE del > o_orderdate + INTERVAL 20 DAY
UNION ALL SELECT 'review_submitted:orders_file:' || event_id, strftime(ts, '%Y-%m-%d %H:%M:%S'), NULL, NULL, NULL, CAST(json_extract_string(props, '$.k') AS DOUBLE),
  CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) BETWEEN 1 AND 5 THEN '' ELSE 'invalid_review_score' END FROM events WHERE event_type = 'view'"""


def churn_file(s, d):
    c = star.table(s, d, "customer").select(
        F.when(F.col("c_custkey") % 53 != 0, F.col("c_custkey").cast("string")).alias("customerID"),
        F.expr("CASE c_custkey % 5 WHEN 0 THEN ' Yes' WHEN 1 THEN '1' WHEN 2 THEN 'No' WHEN 3 THEN '' ELSE 'TRUE' END").alias("Churn"),
        F.when(F.col("c_custkey") % 6 != 0, (F.col("c_custkey") % 72).cast("string")).alias("tenure"), F.col("c_mktsegment").alias("Contract"),
        F.col("c_acctbal").cast("string").alias("TotalCharges"))
    return raw.resolve_columns(c, raw.CHURN_ALIASES, ["customer_id", "churn"])


QUERIES["t11_churn_file_events"] = lambda s, d: silver.churn_file_events(churn_file(s, d), "2001-12-31").select(
    "event_id", "amount", A("tenure"), F.concat_ws(",", "data_quality_flags").alias("flags"))
SQL["t11_churn_file_events"] = """SELECT 'customer_churned:churn_file:' || c_custkey AS event_id, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS amount,
  CASE WHEN c_custkey % 6 <> 0 THEN (c_custkey % 72)::DOUBLE END AS tenure,
  concat_ws(',', CASE WHEN c_custkey % 6 = 0 THEN 'missing_tenure' END, 'missing_monthly_charges', CASE WHEN c_acctbal < 0 THEN 'invalid_total_charges' END) AS flags
FROM customer WHERE c_custkey % 53 <> 0 AND c_custkey % 5 IN (0, 1, 4)"""


def shipment_file(s, d):
    li = star.shipped_lines(s, d).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("tracking_number"), F.col("l_orderkey").cast("string").alias("po_number"),
        F.when(F.col("l_suppkey") % 10 != 0, F.concat(F.lit("carrier "), "l_suppkey")).alias("courier"),
        F.date_format(F.expr("o_orderdate + make_dt_interval(45)"), "yyyy-MM-dd").alias("eta"),
        F.when(F.col("l_linenumber") != 3, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("delivered_date"),
        F.col("l_suppkey").cast("string").alias("supplier"), F.col("l_extendedprice").cast("string").alias("po_value"))
    return raw.resolve_columns(li, raw.SHIPMENT_ALIASES, ["shipment_id", "expected_delivery"])


QUERIES["t12_shipment_file_events"] = lambda s, d: silver.shipment_file_events(shipment_file(s, d)).groupBy("event_type", ts("event_time").alias("event_time")).agg(
    F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"), F.sum("attributes.days_delayed").alias("days_delayed"),
    F.count_if(F.array_contains("data_quality_flags", "missing_carrier")).alias("no_carrier"))
SQL["t12_shipment_file_events"] = """WITH s AS (SELECT *, o_orderdate + INTERVAL 45 DAY AS eta, CASE WHEN l_linenumber <> 3 THEN l_shipdate END AS got FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate),
e AS (SELECT 'shipment_delayed' AS k, got AS t, l_extendedprice AS a, epoch(got - eta) / 86400.0 AS dd, l_suppkey % 10 = 0 AS nc FROM s WHERE got > eta
UNION ALL SELECT 'purchase_order_placed', eta, l_extendedprice, NULL, false FROM s)
SELECT k AS event_type, strftime(t, '%Y-%m-%d %H:%M:%S') AS event_time, count(*) AS n, round(sum(a), 2) AS amount, sum(dd) AS days_delayed, count(*) FILTER (nc) AS no_carrier FROM e GROUP BY 1, 2"""


def ticket_file(s, d):
    e = star.table(s, d, "events").where("event_type in ('error', 'click')")
    k = F.get_json_object("props", "$.k").cast("int")
    t = e.select(F.col("event_id").cast("string").alias("case_id"), F.when(F.col("user_id") % 9 != 0, F.col("user_id").cast("string")).alias("requester_id"),
                 F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("opened_at"),
                 F.when(F.col("event_type") == "click", F.date_format(F.expr("ts + make_dt_interval(0, int(get_json_object(props, '$.k')) - 20)"), "yyyy-MM-dd HH:mm:ss")).alias("resolved_at"),
                 F.when(k % 4 != 0, F.lit("billing")).alias("issue_type"), F.lit("high").alias("urgency"), F.lit("  subject ").alias("title"))
    return raw.resolve_columns(t, raw.TICKET_ALIASES, ["ticket_id", "created_at"])


QUERIES["t13_ticket_file_events"] = lambda s, d: silver.ticket_file_events(ticket_file(s, d)).select(
    "event_id", ts("event_time").alias("event_time"), A("resolution_time_hours"), F.concat_ws(",", "data_quality_flags").alias("flags"))
SQL["t13_ticket_file_events"] = """WITH t AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, date_trunc('second', ts) AS o FROM events WHERE event_type IN ('error', 'click'))
SELECT 'support_ticket_opened:tickets_file:' || event_id AS event_id, strftime(o, '%Y-%m-%d %H:%M:%S') AS event_time, NULL::DOUBLE AS resolution_time_hours,
  concat_ws(',', CASE WHEN user_id % 9 = 0 THEN 'missing_customer_id' END, CASE WHEN k % 4 = 0 THEN 'missing_category' END) AS flags FROM t
UNION ALL SELECT 'support_ticket_closed:tickets_file:' || event_id, strftime(o + to_hours(k - 20), '%Y-%m-%d %H:%M:%S'), CASE WHEN k > 20 THEN (k - 20)::DOUBLE END,
  concat_ws(',', CASE WHEN k <= 20 THEN 'invalid_resolution_time' END, 'missing_satisfaction_score') FROM t WHERE event_type = 'click'"""
QUERIES["t14_safe_casts"] = lambda s, d: star.table(s, d, "documents").agg(
    F.count(raw.safe_text("text")).alias("texts"), F.count(raw.safe_number(F.regexp_extract("text", "[0-9]+", 0))).alias("numbers"),
    F.count(raw.safe_time("source")).alias("times"), F.count(raw.safe_number(F.col("n_chars").cast("string"))).alias("chars"))
SQL["t14_safe_casts"] = """SELECT count(nullif(trim(text), '')) AS texts, count(try_cast(nullif(trim(regexp_extract(text, '[0-9]+')), '') AS DOUBLE)) AS numbers,
  count(try_cast(nullif(trim(source), '') AS TIMESTAMP)) AS times, count(try_cast(n_chars AS DOUBLE)) AS chars FROM documents"""

# --- sources and sinks -----------------------------------------------------------
def _folder(s, name):
    import uuid
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


def _csv(s, d):
    path = _folder(s, "csv")
    star.table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
                                      F.when(F.col("o_orderkey") % 15 == 0, "bad").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("at")) \
        .write.mode("overwrite").option("header", True).csv(path)
    return raw.read_csv(s, path, "o_orderkey bigint, price double, at timestamp").withColumn("at", ts("at"))


QUERIES["s1_csv_source"] = _csv
SQL["s1_csv_source"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS price,
  CASE WHEN o_orderkey % 15 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS at FROM orders"""
QUERIES["s2_alias_resolution"] = lambda s, d: ticket_file(s, d).select("ticket_id", "customer_id", "category", "priority", "status")
SQL["s2_alias_resolution"] = """SELECT CAST(event_id AS VARCHAR) AS ticket_id, CASE WHEN user_id % 9 <> 0 THEN CAST(user_id AS VARCHAR) END AS customer_id,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 4 <> 0 THEN 'billing' END AS category, 'high' AS priority, NULL::VARCHAR AS status FROM events WHERE event_type IN ('error', 'click')"""


def _bronze_roundtrip(s, d):
    path = _folder(s, "bronze")
    raw.write_bronze(bronze(s, d), path)
    return raw.read_bronze(s.read.parquet(path), source="acct", entity_type="Invoice").groupBy("entity_type", "operation").agg(
        F.count("*").alias("n"), F.count_distinct("entity_id").alias("entities"), ts(F.max("created_at")).alias("newest"))


QUERIES["s3_bronze_append"] = _bronze_roundtrip
SQL["s3_bronze_append"] = """SELECT 'Invoice' AS entity_type, 'Create' AS operation, count(*) AS n, count(DISTINCT o_orderkey) AS entities,
  strftime(max(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS newest FROM orders"""
QUERIES["s4_bronze_read"] = lambda s, d: raw.read_bronze(bronze(s, d), "acct", "Invoice", "1999-01-01", 100).select("record_id", ts("created_at").alias("created_at"))
SQL["s4_bronze_read"] = """SELECT 'Invoice:' || o_orderkey AS record_id, strftime(c, '%Y-%m-%d %H:%M:%S') AS created_at FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) AS c FROM orders)
WHERE c >= DATE '1999-01-01' ORDER BY c DESC, 'Invoice:' || o_orderkey LIMIT 100"""
QUERIES["s5_incremental_scan"] = lambda s, d: raw.incremental(bronze(s, d), "2000-06-01").groupBy("entity_type").agg(F.count("*").alias("n"))
SQL["s5_incremental_scan"] = """WITH o AS (SELECT *, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) AS c FROM orders), l AS (SELECT *, CAST(l_shipdate AS DATE) + CAST(l_orderkey % 40 AS INTEGER) AS c FROM lineitem),
x AS (SELECT 'Invoice' AS k, c FROM o UNION ALL SELECT 'Payment', c FROM o WHERE o_orderstatus = 'F' UNION ALL SELECT 'Bill', c FROM l UNION ALL SELECT 'BillPayment', c FROM l WHERE l_linestatus = 'F'
UNION ALL SELECT 'CreditMemo', c FROM l WHERE l_returnflag = 'A' UNION ALL SELECT 'RefundReceipt', c FROM l WHERE l_returnflag = 'R' UNION ALL SELECT 'PurchaseOrder', c FROM l WHERE l_linestatus = 'O')
SELECT k AS entity_type, count(*) AS n FROM x WHERE c > DATE '2000-06-01' GROUP BY k"""
QUERIES["s6_latest_entities"] = lambda s, d: raw.latest_entities(star.bronze_versions(s, d)).select("entity_id", "record_id", ts("created_at").alias("created_at"))
SQL["s6_latest_entities"] = """SELECT CAST(o_custkey AS VARCHAR) AS entity_id, CAST(o_orderkey AS VARCHAR) AS record_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC) AS r FROM orders) WHERE r = 1 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0"""
QUERIES["s7_merge_silver"] = lambda s, d: raw.merge_silver(
    star.activity_events(s, d).unionByName(star.activity_events(s, d)), star.activity_events(s, d).where("event_time < '2024-01-20'")).groupBy("event_type").agg(F.count("*").alias("n"))
SQL["s7_merge_silver"] = """SELECT CASE event_type WHEN 'purchase' THEN 'payment_received' WHEN 'error' THEN 'support_ticket_opened' WHEN 'click' THEN 'support_ticket_closed' WHEN 'signup' THEN 'customer_created' ELSE 'review_submitted' END AS event_type,
  count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1"""
QUERIES["s8_read_events"] = lambda s, d: raw.read_events(star.activity_events(s, d), ["payment_received"], lo="2024-01-10", hi="2024-01-12", limit=50).select(
    "event_id", ts("event_time").alias("event_time"), "amount")
SQL["s8_read_events"] = """SELECT 'app:' || event_id AS event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_time, value AS amount FROM events WHERE event_type = 'purchase'
  AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' ORDER BY ts, 'app:' || event_id LIMIT 50"""


def _gold_roundtrip(s, d):
    path = _folder(s, "gold")
    raw.append_gold(long_panel(s, d, ["daily_revenue", "refund_rate"], star.money_events).where("metric_value is not null"), path)
    return raw.read_gold(s.read.parquet(path), ["refund_rate"], "1996-01-01", "1996-12-31").select(F.date_format("metric_date", "yyyy-MM-dd").alias("metric_date"), "metric_value")


QUERIES["s9_gold_store"] = _gold_roundtrip
SQL["s9_gold_store"] = f"WITH {with_rolled(MONEY)} SELECT strftime(d, '%Y-%m-%d') AS metric_date, refund_rate AS metric_value FROM rolled WHERE d BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"
QUERIES["s10_incident_read"] = lambda s, d: inc_out(raw.read_incidents(panel_incidents(s, d), "margin_compression", "critical", None, "1997-01-01", "1999-12-31"))
SQL["s10_incident_read"] = f"WITH {inc_sql()} {INC_SELECT} WHERE t = 'margin_compression' AND sev = 'critical' AND det BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1999-12-31'"


def _notices(s, d):
    c = star.table(s, d, "customer")
    ent = lambda k, off: F.struct(F.lit(k).alias("name"), (F.col("c_custkey") + off).cast("string").alias("id"), F.lit("Update").alias("operation"),
                                  F.when(F.col("c_custkey") % 13 != 0, "2024-01-05T10:00:00Z").otherwise("?").alias("lastUpdated"))
    body = F.struct(F.array(F.struct(F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey").cast("string")).alias("realmId"), F.struct(
        F.array(ent("Customer", 0), ent("Invoice", 1000)).alias("entities")).alias("dataChangeEvent"))).alias("eventNotifications"))
    return raw.explode_notifications(c.select(F.to_json(body).alias("payload"))).withColumn("last_updated", ts("last_updated"))


QUERIES["s11_webhook_notifications"] = _notices
SQL["s11_webhook_notifications"] = """SELECT CAST(c_nationkey AS VARCHAR) AS realm_id, k AS entity_type, CAST(c_custkey + o AS VARCHAR) AS entity_id, 'Update' AS operation, '2024-01-05 10:00:00' AS last_updated
FROM customer, (VALUES ('Customer', 0), ('Invoice', 1000)) v(k, o) WHERE c_custkey % 7 <> 0 AND c_custkey % 13 <> 0"""


def _audited_fields(records):
    """The fields that the audit reads, of the kinds that it reads: the kept table is small."""
    p = records.where(F.col("entity_type").isin("Invoice", "Bill", "Payment", "Customer")).select("entity_type", F.from_json("raw_payload", raw.PAYLOAD).alias("p"))
    linked = F.flatten(F.transform("p.Line", lambda x: F.transform(x["LinkedTxn"], lambda t: t["TxnId"])))
    return p.select("entity_type", "p.Id", F.col("p.CustomerRef.value").alias("customer"), F.col("p.VendorRef.value").alias("vendor"), "p.TotalAmt",
                    F.when(F.col("entity_type") == "Payment", linked).alias("linked"))


def _audit(s, d):
    p = keep(("parsed", d), lambda: _audited_fields(bronze(s, d)))  # parsed once
    k = lambda t: p.where(F.col("entity_type") == t)
    inv = k("Invoice").select("Id", "customer", "TotalAmt")
    bills = k("Bill").select("Id", "vendor")
    pay = k("Payment").select("TotalAmt", "linked")
    cust = k("Customer").where("Id % 9 <> 0").select(F.col("Id").alias("Id"))  # a column of its own: joined with invoices of the same table
    vend = star.table(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("Id"))
    items = star.table(s, d, "part").select(F.col("p_partkey").cast("string").alias("Id"))
    return raw.audit_dataset(inv, bills, pay, cust, vend, items)


QUERIES["s12_dataset_audit"] = _audit
SQL["s12_dataset_audit"] = """WITH c AS (
SELECT 'completeness' AS "check", 0 AS failures UNION ALL
SELECT 'invoice_customer_integrity', count(*) FROM orders WHERE o_custkey % 50 <> 0 AND (o_custkey % 9 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer)) UNION ALL
SELECT 'bill_vendor_integrity', count(*) FROM lineitem WHERE l_suppkey % 25 <> 0 AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) UNION ALL
SELECT 'payment_amount_consistency', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 20 = 0 AND o_orderkey % 97 <> 0)
SELECT "check", failures, failures = 0 AS passed, avg((failures = 0)::INT) OVER () AS quality_score FROM c"""


def _profile(s, d):
    o = star.table(s, d, "orders")
    orders = o.select(F.col("o_orderkey").alias("order_id"), F.when(F.col("o_custkey") % 40 != 0, F.col("o_custkey")).alias("customer_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("purchased_at"))
    pay = star.table(s, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_returnflag").alias("payment_type"), F.col("l_extendedprice").alias("payment_value"))
    rev = star.activity_events(s, d).where("event_type = 'review_submitted'").select(F.col("attributes.score").alias("review_score"))
    return raw.profile(orders, pay, star.table(s, d, "supplier"), star.table(s, d, "part"), rev)


QUERIES["s13_dataset_profile"] = _profile
SQL["s13_dataset_profile"] = """SELECT 'total_orders' AS statistic, count(*)::VARCHAR AS value FROM orders UNION ALL SELECT 'total_customers', count(DISTINCT o_custkey)::VARCHAR FROM orders WHERE o_custkey % 40 <> 0
UNION ALL SELECT 'first_day', min(o_orderdate)::DATE::VARCHAR FROM orders UNION ALL SELECT 'last_day', max(o_orderdate)::DATE::VARCHAR FROM orders
UNION ALL SELECT 'null_customers', count(*)::VARCHAR FROM orders WHERE o_custkey % 40 = 0
UNION ALL SELECT 'total_revenue', round(sum(l_extendedprice), 2)::DECIMAL(38,2)::VARCHAR FROM lineitem
UNION ALL SELECT 'avg_order_value', round(avg(v), 2)::DECIMAL(38,2)::VARCHAR FROM (SELECT sum(l_extendedprice) AS v FROM lineitem GROUP BY l_orderkey)
UNION ALL SELECT 'total_sellers', count(*)::VARCHAR FROM supplier UNION ALL SELECT 'total_products', count(*)::VARCHAR FROM part
UNION ALL SELECT 'total_reviews', count(*)::VARCHAR FROM events WHERE event_type = 'view'
UNION ALL SELECT 'avg_review_score', round(avg(1 + CAST(json_extract_string(props, '$.k') AS INT) % 5), 4)::DECIMAL(38,4)::VARCHAR FROM events WHERE event_type = 'view'
UNION ALL SELECT 'status:' || o_orderstatus, count(*)::VARCHAR FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'payment:' || l_returnflag, count(*)::VARCHAR FROM lineitem GROUP BY l_returnflag"""

_AUDITED = ("customer", "orders", "lineitem", "documents", "pages", "labels")


def _null_shares(s, d):
    """Every column of six tables; columns of orders and customers are blanked where their keys say so, so that there is something to find."""
    out = None
    for name in _AUDITED:
        df = star.table(s, d, name)
        if name in _BLANKS:
            column, key, step = _BLANKS[name]
            df = df.withColumn(column, F.when(F.col(key) % step != 0, F.col(column)))
        one = raw.null_shares(df, name)
        out = one if out is None else out.unionByName(one)
    return out.withColumn("share", F.round("share", 6))


_BLANKS = {"orders": ("o_totalprice", "o_orderkey", 6), "customer": ("c_acctbal", "c_custkey", 4)}
QUERIES["s13_null_shares"] = _null_shares
# the columns of a table are those of its file: SQL turns each into a text and unpivots them
SQL["s13_null_shares"] = " UNION ALL ".join(
    "SELECT '{t}' AS \"table\", name AS \"column\", (sum((value IS NULL)::INT))::BIGINT AS nulls, count(*) AS rows, round(avg((value IS NULL)::INT), 6) AS share "
    "FROM (SELECT COLUMNS(*)::VARCHAR FROM {src}) UNPIVOT INCLUDE NULLS (value FOR name IN (COLUMNS(*))) GROUP BY name".format(
        t=t, src=t if t not in _BLANKS else "(SELECT * REPLACE (CASE WHEN {1} % {2} <> 0 THEN {0} END AS {0}) FROM {3})".format(*_BLANKS[t], t)) for t in _AUDITED)

# --- quality ---------------------------------------------------------------------------
QUERIES["q1_completeness"] = lambda s, d: quality.completeness(bronze(s, d)).groupBy("entity_type", "completeness").agg(F.count("*").alias("n"))
SQL["q1_completeness"] = """WITH x AS (SELECT 'Invoice' AS k, ((o_orderkey % 97 <> 0)::INT + 2 + (o_custkey % 50 <> 0)::INT) / 4.0 AS c FROM orders
UNION ALL SELECT 'Payment', (3 + (o_custkey % 50 <> 0)::INT) / 4.0 FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'Bill', (3 + (l_suppkey % 25 <> 0)::INT) / 4.0 FROM lineitem
UNION ALL SELECT 'BillPayment', (3 + (l_suppkey % 25 <> 0)::INT) / 4.0 FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT 'CreditMemo', 1 FROM lineitem WHERE l_returnflag = 'A'
UNION ALL SELECT 'RefundReceipt', 1 FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'PurchaseOrder', (2 + (l_suppkey % 25 <> 0)::INT) / 3.0 FROM lineitem WHERE l_linestatus = 'O'
UNION ALL SELECT 'Customer', 1 FROM customer UNION ALL SELECT 'Estimate', 1 FROM nation)
SELECT k AS entity_type, c::DOUBLE AS completeness, count(*) AS n FROM x GROUP BY 1, 2"""
CUT = "2001-07-15"


def _scored(s, d):
    return quality.with_scores(silver.to_silver(bronze(s, d), AS_OF, ["Invoice", "Bill"], quality.SCORED), CUT)


_SCORED = f"""o AS (SELECT *, {_BAL} AS bal, CAST(o_orderdate AS DATE) AS day, o_orderkey % 40 AS lag, o_orderkey % 45 + 1 AS pay FROM orders WHERE o_orderkey % 97 <> 0),
e AS (SELECT 'invoice_issued' AS k, (2 + (day <= DATE '{CUT}')::INT) / 3.0 AS c, lag FROM o
UNION ALL SELECT 'invoice_paid', (day + CAST(pay AS INTEGER) <= DATE '{CUT}')::INT, lag - pay FROM o WHERE bal = 0
UNION ALL SELECT 'invoice_overdue', 0, date_diff('day', DATE '{AS_OF}', day + CAST(lag AS INTEGER)) FROM o WHERE bal > 0 AND day + 30 < DATE '{AS_OF}'
UNION ALL SELECT 'expense_posted', (1 + (CAST(l_shipdate AS DATE) <= DATE '{CUT}')::INT) / 2.0, l_orderkey % 40 FROM lineitem),
q AS (SELECT k, c::DOUBLE AS c, CASE WHEN lag < 1 THEN 1 WHEN lag < 7 THEN .8 WHEN lag < 30 THEN .6 ELSE .4 END::DOUBLE AS t FROM e)"""
QUERIES["q2_consistency"] = lambda s, d: _scored(s, d).groupBy("event_type", F.round("consistency", 6).alias("consistency")).agg(F.count("*").alias("n"))
SQL["q2_consistency"] = f"WITH {_SCORED} SELECT k AS event_type, round(c, 6) AS consistency, count(*) AS n FROM q GROUP BY 1, 2"
QUERIES["q3_timeliness"] = lambda s, d: _scored(s, d).groupBy("event_type", "timeliness").agg(F.count("*").alias("n"))
SQL["q3_timeliness"] = f"WITH {_SCORED} SELECT k AS event_type, t AS timeliness, count(*) AS n FROM q GROUP BY 1, 2"


def _rejects(s, d):
    ev = silver.to_silver(bronze(s, d), AS_OF, ["Invoice"])
    ev = ev.withColumn("currency", F.when(F.col("source_entity_id") % 10 == 0, "US").otherwise("usd")) \
        .withColumn("amount", F.when(F.col("source_entity_id") % 14 == 0, F.col("amount") * 1e8).otherwise(F.col("amount")))
    valid, bad = quality.split_valid(ev)
    return bad.groupBy(F.concat_ws("+", "reasons").alias("reason")).agg(F.count("*").alias("n")).unionByName(
        valid.groupBy("currency").agg(F.count("*").alias("n")).withColumnRenamed("currency", "reason"))


QUERIES["q4_reject_split"] = _rejects
SQL["q4_reject_split"] = f"""WITH o AS (SELECT *, {_BAL} AS bal, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 97 <> 0),
e AS (SELECT o_orderkey AS k, o_totalprice AS a FROM o UNION ALL SELECT o_orderkey, o_totalprice FROM o WHERE bal = 0 UNION ALL SELECT o_orderkey, bal FROM o WHERE bal > 0 AND day + 30 < DATE '{AS_OF}'),
f AS (SELECT concat_ws('+', CASE WHEN k % 10 = 0 THEN 'invalid_currency' END, CASE WHEN k % 14 = 0 AND a * 1e8 > 1e12 THEN 'amount_out_of_range' END) AS x FROM e)
SELECT CASE WHEN x = '' THEN 'USD' ELSE x END AS reason, count(*) AS n FROM f GROUP BY 1"""


def _rejects_whole(s, d):
    """All entity types: currencies and amounts are spoilt where the whole amount says so."""
    ev = silver.to_silver(bronze(s, d), AS_OF)
    whole = F.floor(F.abs("amount"))
    ev = ev.withColumn("currency", F.when(whole % 10 == 0, "US").otherwise("usd")).withColumn("amount", F.when(whole % 14 == 1, F.col("amount") * 1e9).otherwise(F.col("amount")))
    valid, bad = quality.split_valid(written(ev.select("event_type", "event_time", "amount", "currency"), "silver"))  # both sides, one parse
    return bad.groupBy("event_type", F.concat_ws("+", "reasons").alias("reason")).agg(F.count("*").alias("n")).unionByName(
        valid.groupBy("event_type", F.col("currency").alias("reason")).agg(F.count("*").alias("n")))


QUERIES["q4_reject_split_whole"] = _rejects_whole
SQL["q4_reject_split_whole"] = SQL["t9_to_silver"].rsplit("SELECT k AS event_type", 1)[0] + """, f AS (SELECT k, floor(abs(a)) AS w, a FROM x WHERE NOT contains(k, ':')),
g AS (SELECT k, concat_ws('+', CASE WHEN w % 10 = 0 THEN 'invalid_currency' END, CASE WHEN w % 14 = 1 AND abs(a) * 1e9 > 1e12 THEN 'amount_out_of_range' END) AS r FROM f)
SELECT k AS event_type, CASE WHEN r = '' THEN 'USD' ELSE r END AS reason, count(*) AS n FROM g GROUP BY 1, 2"""
QUERIES["q4_batch_totals"] = lambda s, d: quality.batch_totals(silver.order_file_events(*order_files(s, d)).withColumn("currency", F.when(F.col("amount") > 200000, "R$").otherwise(F.col("currency"))))
SQL["q4_batch_totals"] = f"""WITH z AS ({SQL["t10_order_file_events"]})
SELECT count(*) AS total, count(*) FILTER (coalesce(amount, 0) <= 200000) AS valid, count(*) FILTER (coalesce(amount, 0) > 200000) AS rejected FROM z"""
QUERIES["q5_quality_issues"] = lambda s, d: quality.quality_issues(silver.ticket_file_events(ticket_file(s, d)))
SQL["q5_quality_issues"] = f"""WITH z AS ({SQL["t13_ticket_file_events"].replace("WITH t AS", "WITH t AS", 1)}), f AS (SELECT unnest(string_split(flags, ',')) AS flag FROM z)
SELECT flag, count(*) AS count, CASE WHEN flag LIKE 'missing%' THEN 'missing' ELSE 'invalid' END AS issue_type FROM f WHERE flag <> '' GROUP BY flag"""


def _report(s, d):
    b = bronze(s, d).where(F.col("entity_type").isin("Invoice", "Bill"))
    return quality.quality_report(quality.completeness(b), _scored(s, d)).select(
        "events", *[F.round(c, 6).alias(c) for c in ("completeness", "consistency", "timeliness", "overall")], "advisory")


QUERIES["q6_quality_report"] = _report
SQL["q6_quality_report"] = f"""WITH {_SCORED}, cm AS (SELECT avg(c) AS c FROM (SELECT ((o_orderkey % 97 <> 0)::INT + 2 + (o_custkey % 50 <> 0)::INT) / 4.0 AS c FROM orders
  UNION ALL SELECT (3 + (l_suppkey % 25 <> 0)::INT) / 4.0 FROM lineitem)), r AS (SELECT count(*) AS events, any_value(cm.c)::DOUBLE AS completeness, avg(q.c) AS consistency, avg(t) AS timeliness FROM q, cm),
o2 AS (SELECT *, .4::DOUBLE * completeness + .4::DOUBLE * consistency + .2::DOUBLE * timeliness AS overall FROM r)
SELECT events, round(completeness, 6) AS completeness, round(consistency, 6) AS consistency, round(timeliness, 6) AS timeliness, round(overall, 6) AS overall,
  CASE WHEN overall >= .95 THEN 'excellent' WHEN overall >= .85 THEN 'good' WHEN overall >= .7 THEN 'moderate' ELSE 'low' END AS advisory FROM o2"""


def _file_report(s, d):
    f = ticket_file(s, d)
    out = quality.adapter_quality_report(silver.ticket_file_events(f), f.agg(F.count("*").alias("n")))
    return out.select("total", "valid", "rejected", *[F.round(c, 6).alias(c) for c in ("completeness", "consistency", "timeliness", "overall")], "advisory")


QUERIES["q7_file_quality_report"] = _file_report
SQL["q7_file_quality_report"] = f"""WITH z AS ({SQL["t13_ticket_file_events"]}), n AS (SELECT count(*) AS total FROM events WHERE event_type IN ('error', 'click')),
r AS (SELECT any_value(total) AS total, any_value(total) AS valid, greatest(0, 1 - sum(CASE WHEN flags = '' THEN 0 ELSE len(string_split(flags, ',')) END) / (5.0 * any_value(total))) AS c FROM z, n)
SELECT total, valid, 0::BIGINT AS rejected, round(c, 6)::DOUBLE AS completeness, 1.0::DOUBLE AS consistency, 1.0::DOUBLE AS timeliness, round(.4 * c + .6, 6)::DOUBLE AS overall,
  CASE WHEN .4 * c + .6 >= .95 THEN 'excellent' WHEN .4 * c + .6 >= .85 THEN 'good' ELSE 'moderate' END AS advisory FROM r"""


def _win_quality(s, d):
    from panelwise.operators import incidents
    ev = silver.to_silver(bronze(s, d), AS_OF, ["Invoice"]).where("event_type = 'invoice_issued'")
    q = incidents.window_quality(panel_incidents(s, d, 3), ev)
    return q.withColumn("data_quality_score", F.round("data_quality_score", 6))


QUERIES["q8_window_quality"] = _win_quality
SQL["q8_window_quality"] = f"""WITH {inc_sql()}, dd AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n, count(*) FILTER (o_custkey % 50 = 0) AS b FROM orders WHERE o_orderkey % 97 <> 0 GROUP BY 1)
SELECT id AS incident_id, round(coalesce(1 - sum(b) / sum(n), 0), 6)::DOUBLE AS data_quality_score FROM inc LEFT JOIN dd ON dd.d BETWEEN inc.d - 2 AND inc.d GROUP BY id"""
QUERIES["q9_coverage_quality"] = lambda s, d: quality.coverage_quality(long_panel(s, d), "1995-01-01", "1995-06-30").withColumn("coverage", F.round("coverage", 6))
from checks.detect import long_sql  # noqa: E402

SQL["q9_coverage_quality"] = f"""WITH {long_sql()}, c AS (SELECT m, count(*) AS days, least(1, count(*) / 181.0) AS cov FROM gold WHERE v IS NOT NULL AND d BETWEEN DATE '1995-01-01' AND DATE '1995-06-30' GROUP BY m)
SELECT m AS metric_name, days, round(cov, 6)::DOUBLE AS coverage, CASE WHEN cov >= .9 THEN 1 WHEN cov >= .7 THEN .9 WHEN cov >= .5 THEN .75 ELSE .5 END::DOUBLE AS quality FROM c"""
