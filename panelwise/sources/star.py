"""Domain views over the provided star-schema tables.

The operators work on canonical events; these functions derive such events
(and raw bronze records) from ``orders``, ``lineitem``, ``customer`` and
``events`` by projection, so the work of every query grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ATTRIBUTES = (
    "days_to_pay double, balance double, balance_remaining double, days_overdue double, "
    "days_late double, days_delayed double, resolution_time_hours double, score double, "
    "due_date date, original_due_date date"
)
PROMISED_DAYS = 60.0
SUPPLIER_DAYS = 90.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _attributes(**given: Column) -> Column:
    fields = []
    for part in ATTRIBUTES.split(", "):
        name, kind = part.split(" ")
        fields.append(given.get(name, F.lit(None)).cast(kind).alias(name))
    return F.struct(*fields)


def _entity(kind: str, key: str | Column) -> Column:
    return F.concat_ws(":", F.lit(kind), F.lit("shop"), F.col(key) if isinstance(key, str) else key)


def _event(kind: str, key: Column, time: Column, entity_type: str, entity: Column, *, amount: Column | None = None,
           customer: Column | None = None, vendor: Column | None = None, product: Column | None = None,
           order: Column | None = None, **attributes: Column) -> dict:
    """Column expressions of one event kind; see ``_fan_out``."""
    related = {"customer": customer, "vendor": vendor, "product": product, "order": order}
    return {
        "kind": kind, "event_id": key, "event_time": time, "entity_type": entity_type, "entity_id": entity,
        "related": {name: col for name, col in related.items() if col is not None}, "amount": amount, "attributes": attributes,
    }


def _related(columns: dict[str, Column]) -> Column:
    pairs = [x for name, col in columns.items() for x in (F.lit(name), col)]
    return F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")


def _same(a, b) -> bool:
    """Whether two events were given the very same columns or values."""
    if isinstance(a, dict) and isinstance(b, dict):
        return list(a) == list(b) and all(a[k] is b[k] for k in a)
    return a is b or (isinstance(a, str) and a == b)


def _on(condition: Column, event: dict) -> dict:
    return {**event, "condition": condition}


#: Names that an event can be related to; ``linked`` views hold each as a column ``related_<name>`` beside the map.
LINKS = ("customer", "vendor", "product", "order")


def _fan_out(df: DataFrame, *events: dict, linked: bool = False) -> DataFrame:
    """One row per event that applies.

    Only the event kinds are exploded; every other column is chosen by kind
    after the explode, so columns a query does not read are never computed.
    What all kinds have in common is not chosen at all. ``df`` holds the texts
    that several kinds use (keys, entities), which are made once a row.
    """
    kinds = [F.when(e["condition"], e["kind"]) if "condition" in e else F.lit(e["kind"]) for e in events]
    x = df.withColumn("event_type", F.explode(F.array(*kinds))).where("event_type IS NOT NULL")

    def pick(choose) -> Column:
        out = None
        for e in events:
            here = F.col("event_type") == e["kind"]
            out = F.when(here, choose(e)) if out is None else out.when(here, choose(e))
        return out

    def plain(name: str, make) -> Column:
        if all(_same(e[name], events[0][name]) for e in events):
            return make(events[0][name])
        return pick(lambda e: make(e[name]))
    fields = []
    for part in ATTRIBUTES.split(", "):
        name, kind = part.split(" ")
        having = any(name in e["attributes"] for e in events)
        value = pick(lambda e, name=name, kind=kind: e["attributes"].get(name, F.lit(None)).cast(kind)) if having else F.lit(None).cast(kind)
        fields.append(value.alias(name))
    none = F.lit(None).cast("string")

    def link(name: str) -> Column:
        given = [e["related"].get(name) for e in events]
        if all(c is given[0] for c in given):
            return none if given[0] is None else given[0]
        return pick(lambda e: e["related"].get(name, none))
    links = [link(name).alias(f"related_{name}") for name in LINKS] if linked else []
    return x.select(
        pick(lambda e: F.concat_ws(":", F.lit(e["kind"]), e["event_id"])).alias("event_id"), "event_type",
        plain("event_time", lambda c: c.cast("timestamp")).alias("event_time"), plain("entity_type", F.lit).alias("entity_type"),
        plain("entity_id", lambda c: c).alias("entity_id"), plain("related", _related).alias("related"),
        plain("amount", lambda c: (F.lit(None) if c is None else c).cast("double")).alias("amount"), F.struct(*fields).alias("attributes"), *links)


def order_events(spark: SparkSession, sf_dir: str, linked: bool = False) -> DataFrame:
    """orders -> order_placed, invoice_issued, invoice_paid (F) or invoice_overdue (O), one pass."""
    o = table(spark, sf_dir, "orders").withColumns({"_key": F.col("o_orderkey").cast("string"), "_customer": _entity("customer", "o_custkey")}) \
        .withColumns({"_order": _entity("order", "_key"), "_invoice": _entity("invoice", "_key")})
    key, customer, invoice = F.col("_key"), F.col("_customer"), F.col("_invoice")
    day, total = F.col("o_orderdate"), F.col("o_totalprice")
    due = F.date_add(F.to_date(day), 30)
    return _fan_out(
        o,
        _event("order_placed", key, day, "order", F.col("_order"), amount=total, customer=customer),
        _event("invoice_issued", key, day, "invoice", invoice, amount=total, customer=customer, due_date=due,
               balance=F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(total)),
        _on(F.col("o_orderstatus") == "F", _event("invoice_paid", key, day, "invoice", invoice, amount=total, customer=customer,
                      days_to_pay=F.col("o_orderkey") % 45 + 1)),
        _on(F.col("o_orderstatus") == "O", _event("invoice_overdue", key, day, "invoice", invoice, amount=total, customer=customer,
                      balance_remaining=total, days_overdue=F.col("o_orderkey") % 120, original_due_date=due)),
        linked=linked)


def _line_entities(lines: DataFrame) -> DataFrame:
    """Line items with the texts of their key and entities."""
    return lines.withColumns({
        "_key": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.unix_date(F.to_date("l_shipdate"))),
        "_vendor": _entity("vendor", "l_suppkey"), "_product": _entity("product", "l_partkey"), "_order": _entity("order", "l_orderkey")})


def ledger_events(spark: SparkSession, sf_dir: str, linked: bool = False) -> DataFrame:
    """lineitem -> expense_posted, refund_issued (R), expense_paid (F) or purchase_order_placed (O)."""
    li = _line_entities(table(spark, sf_dir, "lineitem")).withColumn("_expense", _entity("expense", "_key"))
    key, vendor, product, order, expense = (F.col(c) for c in ("_key", "_vendor", "_product", "_order", "_expense"))
    day, gross = F.col("l_shipdate"), F.col("l_extendedprice")
    tax = gross * F.col("l_tax")
    return _fan_out(
        li,
        _event("expense_posted", key, day, "expense", expense, amount=tax, vendor=vendor),
        _on(F.col("l_returnflag") == "R", _event("refund_issued", key, day, "payment", _entity("payment", key),
                      amount=gross * (1 - F.col("l_discount")), product=product, order=order)),
        _on(F.col("l_linestatus") == "F", _event("expense_paid", key, day, "expense", expense, amount=tax, vendor=vendor)),
        _on(F.col("l_linestatus") == "O", _event("purchase_order_placed", key, day, "order", order, amount=gross, vendor=vendor,
                      product=product)),
        linked=linked)


def shipped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items joined to their order where the ship date is not before the order date."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate")


def shipment_events(spark: SparkSession, sf_dir: str, linked: bool = False) -> DataFrame:
    """Shipped lines -> order_delivered, order_late (> 60 days), shipment_delayed (> 90 days)."""
    s = _line_entities(shipped_lines(spark, sf_dir)).withColumn("_customer", _entity("customer", "o_custkey"))
    key, vendor, product, order, customer = (F.col(c) for c in ("_key", "_vendor", "_product", "_order", "_customer"))
    day = F.col("l_shipdate")
    taken = (F.unix_timestamp("l_shipdate") - F.unix_timestamp("o_orderdate")) / 86400.0
    return _fan_out(
        s,
        _event("order_delivered", key, day, "order", order, customer=customer, product=product),
        _on(taken > PROMISED_DAYS, _event("order_late", key, day, "order", order, customer=customer, product=product,
                      days_late=taken - PROMISED_DAYS)),
        _on(taken > SUPPLIER_DAYS, _event("shipment_delayed", key, day, "order", order, vendor=vendor, customer=customer,
                      days_delayed=taken - SUPPLIER_DAYS)),
        linked=linked)


def churn_events(spark: SparkSession, sf_dir: str, linked: bool = False) -> DataFrame:
    """Customers with a negative balance count as churned on a day derived from their key."""
    c = table(spark, sf_dir, "customer").where("c_acctbal < 0")
    key = F.col("c_custkey").cast("string")
    day = F.expr("date_add(DATE'1995-01-01', int(c_custkey * 37 % 2400))")
    return _fan_out(c, _event("customer_churned", key, day, "customer", _entity("customer", key),
                              amount=F.lit(None)), linked=linked)


def _ticket_kinds() -> list[dict]:
    """Tickets and reviews derived from the priority of an order."""
    key, day = F.col("o_orderkey").cast("string"), F.col("o_orderdate")
    customer, ticket, priority = _entity("customer", "o_custkey"), _entity("ticket", key), F.col("o_orderpriority")
    return [
        _on(priority.isin("1-URGENT", "2-HIGH"), _event("support_ticket_opened", key, day, "ticket", ticket, customer=customer)),
        _on(priority == "5-LOW", _event("support_ticket_closed", key, day, "ticket", ticket, customer=customer,
                      resolution_time_hours=F.col("o_orderkey") % 72)),
        _on(priority == "3-MEDIUM", _event("review_submitted", key, day, "order", _entity("order", key), customer=customer,
                      score=1 + F.col("o_custkey") % 5)),
    ]


def support_panel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets and reviews derived from order priorities, with paid invoices and churn."""
    key, day, customer = F.col("o_orderkey").cast("string"), F.col("o_orderdate"), _entity("customer", "o_custkey")
    return _fan_out(
        table(spark, sf_dir, "orders"),
        *_ticket_kinds(),
        _on(F.col("o_orderstatus") == "F", _event("invoice_paid", key, day, "invoice", _entity("invoice", key), amount=F.col("o_totalprice"),
                      customer=customer, days_to_pay=F.col("o_orderkey") % 45 + 1)),
    ).unionByName(churn_events(spark, sf_dir))


def order_panel_events(spark: SparkSession, sf_dir: str, linked: bool = False) -> DataFrame:
    """All events of the order panel (1995-2001)."""
    return (
        order_events(spark, sf_dir, linked)
        .unionByName(ledger_events(spark, sf_dir, linked))
        .unionByName(shipment_events(spark, sf_dir, linked))
        .unionByName(churn_events(spark, sf_dir, linked))
    )


def whole_panel_events(spark: SparkSession, sf_dir: str, linked: bool = False) -> DataFrame:
    """All events of the order panel and its tickets and reviews: every one of the 27 metrics has a source."""
    return order_panel_events(spark, sf_dir, linked).unionByName(_fan_out(table(spark, sf_dir, "orders"), *_ticket_kinds(), linked=linked))


def money_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the branches that carry money: no join is needed for the financial metrics."""
    return order_events(spark, sf_dir).unionByName(ledger_events(spark, sf_dir))


def activity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The activity panel (30 days): every row of ``events`` becomes one canonical event."""
    e = table(spark, sf_dir, "events")
    return activity_from(e)


def activity_from(e: DataFrame) -> DataFrame:
    """Row-wise mapping used by both the batch and the streaming source."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.expr(
        "CASE event_type WHEN 'purchase' THEN 'payment_received' WHEN 'error' THEN 'support_ticket_opened' "
        "WHEN 'click' THEN 'support_ticket_closed' WHEN 'signup' THEN 'customer_created' "
        "WHEN 'view' THEN 'review_submitted' END")
    entity_type = F.expr(
        "CASE event_type WHEN 'purchase' THEN 'payment' WHEN 'error' THEN 'ticket' WHEN 'click' THEN 'ticket' "
        "WHEN 'signup' THEN 'customer' WHEN 'view' THEN 'order' END")
    customer = F.concat_ws(":", F.lit("customer"), F.lit("app"), "user_id")
    return e.select(
        F.concat_ws(":", F.lit("app"), "event_id").alias("event_id"),
        kind.alias("event_type"),
        F.col("ts").cast("timestamp").alias("event_time"),
        entity_type.alias("entity_type"),
        F.when(F.col("event_type") == "signup", customer)
        .otherwise(F.concat_ws(":", entity_type, F.lit("app"), "event_id")).alias("entity_id"),
        F.create_map(F.lit("customer"), customer).alias("related"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("amount"),
        _attributes(
            resolution_time_hours=F.when(F.col("event_type") == "click", k),
            score=F.when(F.col("event_type") == "view", 1 + k % 5),
        ).alias("attributes"),
    )


# --- raw (bronze) records ------------------------------------------------------
def _ref(value: Column, cond: Column | None = None) -> Column:
    s = F.struct(value.cast("string").alias("value"))
    return s if cond is None else F.when(cond, s)


def _record(df: DataFrame, entity_type: str, key: Column, payload: Column, created: Column, operation: str = "Create") -> DataFrame:
    return df.select(
        F.concat_ws(":", F.lit(entity_type), key).alias("record_id"), key.alias("entity_id"),
        F.lit(entity_type).alias("entity_type"), F.lit("acct").alias("source"), F.lit(operation).alias("operation"),
        F.to_json(payload).alias("raw_payload"), created.cast("timestamp").alias("created_at"))


def _iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def bronze_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounting-style raw JSON records derived row by row from the star tables."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey").cast("string")) \
        .withColumn("day", F.to_date("o_orderdate")).withColumn("total", F.col("o_totalprice"))
    created = F.date_add("day", (F.col("o_orderkey") % 40).cast("int"))
    text_day = F.col("day").cast("string")
    has_customer = F.col("o_custkey") % 50 != 0

    def sale(amount: Column) -> Column:
        return F.struct(F.lit("SalesItemLineDetail").alias("DetailType"), amount.alias("Amount"),
                        F.struct(F.lit(1.0).alias("Qty"), _ref(F.col("o_custkey")).alias("ItemRef")).alias("SalesItemLineDetail"))
    subtotal = F.struct(F.lit("SubTotalLineDetail").alias("DetailType"), F.col("total").alias("Amount"),
                        F.lit(None).cast("struct<Qty:double,ItemRef:struct<value:string>>").alias("SalesItemLineDetail"))
    paid_at = F.date_add("day", (F.col("o_orderkey") % 45 + 1).cast("int")).cast("timestamp")
    invoice = _record(o, "Invoice", F.col("k"), F.struct(
        F.when(F.col("o_orderkey") % 97 != 0, F.col("k")).alias("Id"), F.concat(F.lit("INV-"), "k").alias("DocNumber"),
        text_day.alias("TxnDate"), F.date_add("day", 30).cast("string").alias("DueDate"), F.col("total").alias("TotalAmt"),
        F.when(F.col("o_orderstatus") == "F", 0.0).when(F.col("o_orderstatus") == "O", F.col("total") / 2).alias("Balance"),
        _ref(F.col("o_custkey"), has_customer).alias("CustomerRef"), F.struct(F.lit("USD").alias("value")).alias("CurrencyRef"),
        F.array(sale(F.col("total") * 0.75), sale(F.col("total") * 0.25), subtotal).alias("Line"),
        F.when(F.col("o_orderstatus") == "F", F.struct(_iso(paid_at).alias("LastUpdatedTime"))).alias("MetaData")), created)
    off = F.when(F.col("o_orderkey") % 20 == 0, F.col("total") - 1).otherwise(F.col("total"))
    payment = _record(o.where("o_orderstatus = 'F'"), "Payment", F.concat(F.lit("P"), "k"), F.struct(
        F.concat(F.lit("P"), "k").alias("Id"), F.date_add("day", 10).cast("string").alias("TxnDate"), off.alias("TotalAmt"),
        _ref(F.col("o_custkey"), has_customer).alias("CustomerRef"),
        F.struct(F.col("o_orderpriority").alias("name")).alias("PaymentMethodRef"),
        F.array(F.struct(off.alias("Amount"), F.array(
            F.struct(F.col("k").alias("TxnId"), F.lit("Invoice").alias("TxnType")),
            F.struct(F.lit("J1").alias("TxnId"), F.lit("JournalEntry").alias("TxnType"))).alias("LinkedTxn"))).alias("Line")), created)
    li = table(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate")).withColumn(
        "k", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.unix_date("day"))).withColumn("total", F.col("l_extendedprice"))
    l_created, l_day = F.date_add("day", (F.col("l_orderkey") % 40).cast("int")), F.col("day").cast("string")
    vendor = _ref(F.col("l_suppkey"), F.col("l_suppkey") % 25 != 0)
    account = F.struct(F.lit("AccountBasedExpenseLineDetail").alias("DetailType"), F.col("total").alias("Amount"), F.struct(F.struct(
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("name"), F.lit("7").alias("value")).alias("AccountRef"))
        .alias("AccountBasedExpenseLineDetail"))

    def line_record(df: DataFrame, kind: str, prefix: str, **fields: Column) -> DataFrame:
        key = F.concat(F.lit(prefix), "k")
        return _record(df, kind, key, F.struct(key.alias("Id"), l_day.alias("TxnDate"), F.col("total").alias("TotalAmt"),
                                               *[c.alias(n) for n, c in fields.items()]), l_created)
    bill = line_record(li, "Bill", "B", VendorRef=vendor, DueDate=F.date_add("day", 15).cast("string"), Line=F.array(account))
    bill_payment = line_record(li.where("l_linestatus = 'F'"), "BillPayment", "BP", VendorRef=vendor, PaymentType=F.lit("Check"), Line=F.array(
        F.struct(F.col("total").alias("Amount"), F.array(F.struct(F.concat(F.lit("B"), "k").alias("TxnId"), F.lit("Bill").alias("TxnType"))).alias("LinkedTxn"))))
    part_ref = _ref(F.col("l_partkey"))
    memo = line_record(li.where("l_returnflag = 'A'"), "CreditMemo", "CM", CustomerRef=part_ref, CustomerMemo=_ref(F.col("l_linestatus")))
    refund = line_record(li.where("l_returnflag = 'R'"), "RefundReceipt", "RR", CustomerRef=part_ref, PaymentType=F.lit("Card"))
    po = line_record(li.where("l_linestatus = 'O'"), "PurchaseOrder", "PO", VendorRef=vendor, ShipDate=F.date_add("day", 7).cast("string"))
    c = table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey").cast("string"))
    made = F.to_timestamp(F.lit("1994-01-01 00:00:00"))
    touched = F.when(F.col("c_custkey") % 3 == 0, F.lit("1994-01-01T00:00:30Z")).otherwise(F.lit("1994-01-06T00:00:00Z"))
    customer = _record(c, "Customer", F.col("k"), F.struct(
        F.col("k").alias("Id"), F.col("c_name").alias("DisplayName"), F.col("c_acctbal").alias("Balance"),
        F.when(F.col("c_custkey") % 3 != 2, F.struct(F.lit("1994-01-01T00:00:00Z").alias("CreateTime"), touched.alias("LastUpdatedTime"))).alias("MetaData")), made)
    n = table(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey").cast("string"))
    unknown = _record(n, "Estimate", F.col("k"), F.struct(F.col("k").alias("Id")), made)
    out = invoice
    for part in (payment, bill, bill_payment, memo, refund, po, customer, unknown):
        out = out.unionByName(part)
    return out


def bronze_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several operations per customer: every order of a customer is one version of its record."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("record_id"), F.col("o_custkey").cast("string").alias("entity_id"),
        F.lit("Customer").alias("entity_type"), F.lit("acct").alias("source"),
        F.expr("CASE WHEN o_orderkey % 7 = 0 THEN 'Delete' WHEN o_orderkey % 11 = 0 THEN 'Void' ELSE 'Update' END").alias("operation"),
        F.to_json(F.struct(F.col("o_totalprice").alias("Balance"))).alias("raw_payload"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"))
