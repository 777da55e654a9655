"""Raw records -> canonical events.

One record fans out into zero to three events inside a single projection, so
every transform reads its input once and never shuffles it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.sources.raw import PAYLOAD, safe_number, safe_text, safe_time

ATTRS = (
    "doc_number string, due_date string, original_due_date string, expected_date string, balance double, "
    "balance_remaining double, days_to_pay double, days_overdue double, paid_date timestamp, payment_method string, "
    "category string, reason string, display_name string, email string, days_late double, delivery_days double, "
    "days_delayed double, carrier string, resolution_time_hours double, satisfaction_score double, subject string, "
    "score double, comment string, tenure double, contract_type string, monthly_charges double, total_charges double, "
    "seller_id string, linked array<struct<id:string,amount:double>>, product_ids array<string>, "
    "line_items array<struct<description:string,amount:double,quantity:double,item_id:string>>"
)
#: Payload fields behind the plain columns of an event, behind each attribute that needs more, and the fields of a line behind what is read of lines.
_PLAIN = {"Id", "TxnDate", "DueDate", "TotalAmt", "Balance", "CurrencyRef", "CustomerRef", "VendorRef", "MetaData"}
_MORE = {"doc_number": {"DocNumber"}, "expected_date": {"ShipDate"}, "payment_method": {"PaymentMethodRef", "PaymentType"}, "reason": {"CustomerMemo"},
         "display_name": {"DisplayName"}, "email": {"PrimaryEmailAddr"}}
_SALE, _ITEM, _ACCOUNT = "SalesItemLineDetail", "ItemBasedExpenseLineDetail", "AccountBasedExpenseLineDetail"
_OF_LINES = {"category": {"DetailType", _ACCOUNT}, "linked": {"Amount", "LinkedTxn"}, "line_items": {"DetailType"}}
_OF_ITEMS = {"description": {"Description"}, "amount": {"Amount"}, "quantity": {_SALE, _ITEM}, "item_id": {_SALE, _ITEM, _ACCOUNT}}
ENTITY_KINDS = ["Invoice", "Payment", "Bill", "BillPayment", "CreditMemo", "RefundReceipt", "Customer", "PurchaseOrder"]


def _flags(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, name) for cond, name in pairs], F.lit(None).cast("string")))


def _eid(kind: str, key: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), F.col("source"), key)


def make_event(kind: str | Column, time: Column, entity_type: str, key: Column, *, entity_kind: str | None = None,
               related: dict[str, Column] | None = None, amount: Column | None = None, currency: Column | str = "USD",
               flags: Column | None = None, **attrs: Column) -> dict[str, Column | dict[str, Column]]:
    """Column expressions of one canonical event (see ``fan_out``); ids are derived from the natural key."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    entries = [F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), _eid(k, v).alias("value"))) for k, v in (related or {}).items()]
    empty = F.struct(F.lit("").alias("key"), F.lit("").alias("value"))
    rel = F.map_from_entries(F.array_compact(F.array(*entries, F.when(F.lit(False), empty))))
    return {
        "event_id": F.concat_ws(":", kind, F.col("source"), key), "event_type": kind, "event_time": time, "ingested_at": F.col("ingested_at"),
        "source": F.col("source"), "source_entity_id": key, "entity_type": F.lit(entity_type), "entity_id": _eid(entity_kind or entity_type, key),
        "related": rel, "amount": (F.lit(None) if amount is None else amount).cast("double"),
        "currency": F.lit(currency) if isinstance(currency, str) else currency, "attributes": attrs,
        "data_quality_flags": _flags() if flags is None else flags}


def fan_out(df: DataFrame, *events: tuple[Column, dict], attributes: str = ATTRS, turns: list[int] | None = None) -> DataFrame:
    """One row per (condition, event) that applies, with the named attributes.

    Only the number of the event is exploded, without a lambda. All columns are
    chosen by it after the explode, so a query computes no column that it does
    not read. Events with the same turn exclude each other and share a place in
    the exploded array (default: each has its own).
    """
    table = [e for _, e in events]
    places: dict[int, Column] = {}
    for i, (cond, _) in enumerate(events):
        turn = turns[i] if turns else i
        places[turn] = places[turn].when(cond, F.lit(i)) if turn in places else F.when(cond, F.lit(i))

    def pick(cells: dict[int, Column]) -> Column:
        out = None
        for i, cell in cells.items():
            here = F.col("_event") == i
            out = F.when(here, cell) if out is None else out.when(here, cell)
        return F.lit(None) if out is None else out
    plain = [pick({i: e[name] for i, e in enumerate(table)}).alias(name) for name in table[0] if name not in ("attributes", "data_quality_flags")]
    named = [part.strip().split(" ", 1) for part in attributes.split(", ")]
    fields = [pick({i: e["attributes"][n].cast(t) for i, e in enumerate(table) if n in e["attributes"]}).cast(t).alias(n) for n, t in named]
    flags = pick({i: e["data_quality_flags"] for i, e in enumerate(table)}).alias("data_quality_flags")
    return df.withColumn("_event", F.explode(F.array(*places.values()))).where("_event IS NOT NULL") \
        .select(*plain, F.struct(*fields).alias("attributes"), flags)


def _item_fields(attributes: str) -> list[str]:
    """Fields of a line item that an attribute schema names."""
    wanted = T.StructType.fromDDL(attributes)
    return wanted["line_items"].dataType.elementType.names if "line_items" in wanted.names else []


def payload_schema(attributes: str) -> T.StructType:
    """The part of ``PAYLOAD`` behind the plain columns of an event and the named attributes."""
    names, items = T.StructType.fromDDL(attributes).names, _item_fields(attributes)
    top = _PLAIN.union(*[_MORE.get(n, set()) for n in names])
    line = set().union(*[_OF_LINES.get(n, set()) for n in names], *[_OF_ITEMS[n] for n in items])
    out = []
    for f in T.StructType.fromDDL(PAYLOAD):
        if f.name == "Line" and line:
            out.append(T.StructField("Line", T.ArrayType(T.StructType([x for x in f.dataType.elementType if x.name in line]))))
        elif f.name in top:
            out.append(f)
    return T.StructType(out)


def parse_payload(bronze: DataFrame, schema: T.StructType | str = PAYLOAD) -> DataFrame:
    return bronze.select("record_id", "entity_type", "source", F.col("created_at").alias("ingested_at"),
                         F.from_json("raw_payload", schema).alias("p"))


def line_items(lines: Column, names: list[str]) -> Column:
    """Kept lines in one shape, with the named fields: sub-totals and discounts dropped, quantity and item id by detail type."""
    kept = F.filter(lines, lambda x: ~F.coalesce(x["DetailType"].isin("SubTotalLineDetail", "DiscountLineDetail"), F.lit(False)))

    def shape(x: Column) -> Column:
        kind = x["DetailType"]
        sale, item, account = (x[n] for n in (_SALE, _ITEM, _ACCOUNT))
        made = {
            "description": x["Description"], "amount": x["Amount"],
            "quantity": F.when(kind == _SALE, sale["Qty"]).when(kind == _ITEM, item["Qty"]),
            "item_id": F.when(kind == _SALE, sale["ItemRef"]["value"]).when(kind == _ITEM, item["ItemRef"]["value"])
            .when(kind == _ACCOUNT, account["AccountRef"]["value"])}
        return F.struct(*[made[n].alias(n) for n in names])
    return F.transform(kept, shape)


def linked_transactions(lines: Column, kind: str) -> Column:
    return F.flatten(F.transform(lines, lambda x: F.transform(
        F.filter(F.coalesce(x["LinkedTxn"], F.array().cast("array<struct<TxnId:string,TxnType:string>>")),
                 lambda t: t["TxnType"] == kind),
        lambda t: F.struct(t["TxnId"].alias("id"), x["Amount"].alias("amount")))))


def _payment_method() -> Column:
    return F.coalesce("p.PaymentMethodRef.name", "p.PaymentMethodRef.value", "p.PaymentType")


def _party(role: str) -> tuple[dict[str, Column], tuple[Column, str]]:
    ref = safe_text(f"p.{role.capitalize()}Ref.value")
    return {role: ref}, (ref.isNull(), f"missing_{role}_ref")


def _api_events(as_of: Column, item_fields: list[str]) -> dict[str, list[tuple[Column, dict]]]:
    """Events per raw entity type, each with its condition, over the parsed payload ``p`` and its ``_key``."""
    key = F.col("_key")
    known = key.isNotNull()
    txn = safe_time("p.TxnDate")
    when = F.coalesce(txn, as_of)
    total, currency = F.col("p.TotalAmt"), F.coalesce("p.CurrencyRef.value", F.lit("USD"))
    customer, no_customer = _party("customer")
    vendor, no_vendor = _party("vendor")
    bad_date = (txn.isNull(), "invalid_txn_date")
    buyer = dict(related=customer, amount=total, currency=currency)
    seller = dict(related=vendor, amount=total, currency=currency, flags=_flags(no_vendor))
    due, balance = safe_time("p.DueDate"), F.coalesce("p.Balance", total)
    paid = safe_time("p.MetaData.LastUpdatedTime")
    inv_flags = _flags(no_customer, bad_date)
    items = line_items(F.col("p.Line"), item_fields)
    created, updated = safe_time("p.MetaData.CreateTime"), safe_time("p.MetaData.LastUpdatedTime")
    is_new = F.coalesce(F.abs(F.unix_timestamp(updated) - F.unix_timestamp(created)) < 60, F.lit(True))
    category = F.get(F.filter("p.Line", lambda x: x["DetailType"] == "AccountBasedExpenseLineDetail"), F.lit(0))
    account = category["AccountBasedExpenseLineDetail"]["AccountRef"]

    def only(cond: Column, event: dict) -> tuple[Column, dict]:
        return known & cond, event

    yes = F.lit(True)
    return {
        "Invoice": [
            only(yes, make_event("invoice_issued", when, "invoice", key, flags=inv_flags, doc_number=F.col("p.DocNumber"),
                                 due_date=F.col("p.DueDate"), balance=balance, line_items=items, **buyer)),
            only(balance == 0, make_event(
                "invoice_paid", F.coalesce(paid, when), "invoice", key, flags=inv_flags, paid_date=paid,
                payment_method=_payment_method(), days_to_pay=F.datediff(paid, txn), original_due_date=F.col("p.DueDate"), **buyer)),
            only((balance > 0) & (due < as_of), make_event(
                "invoice_overdue", as_of, "invoice", key, related=customer, amount=balance, currency=currency, flags=inv_flags,
                days_overdue=F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(due)) / 86400), balance_remaining=balance,
                original_due_date=F.col("p.DueDate")))],
        "Payment": [only(yes, make_event("payment_received", when, "payment", key, flags=_flags(no_customer),
                                         payment_method=_payment_method(),
                                         linked=linked_transactions(F.col("p.Line"), "Invoice"), **buyer))],
        "Bill": [only(yes, make_event("expense_posted", when, "expense", key, due_date=F.col("p.DueDate"), line_items=items,
                                      category=F.coalesce(account["name"], account["value"]), **seller))],
        "BillPayment": [only(yes, make_event("expense_paid", when, "expense", key, payment_method=_payment_method(),
                                             linked=linked_transactions(F.col("p.Line"), "Bill"), **seller))],
        "CreditMemo": [only(yes, make_event("credit_memo_issued", when, "invoice", key, flags=_flags(no_customer),
                                            line_items=items, reason=F.col("p.CustomerMemo.value"), **buyer))],
        "RefundReceipt": [only(yes, make_event("refund_issued", when, "payment", key, flags=_flags(no_customer),
                                               line_items=items, payment_method=_payment_method(), **buyer))],
        "Customer": [only(yes, make_event(
            F.when(is_new, "customer_created").otherwise("customer_updated"),
            F.coalesce(F.when(is_new, created).otherwise(updated), as_of), "customer", key,
            display_name=F.col("p.DisplayName"), email=F.col("p.PrimaryEmailAddr.Address"),
            balance=F.coalesce("p.Balance", F.lit(0.0))))],
        "PurchaseOrder": [only(yes, make_event("purchase_order_placed", when, "order", key, line_items=items,
                                               expected_date=F.col("p.ShipDate"), **seller))],
    }


def to_silver(bronze: DataFrame, as_of: str, kinds: list[str] | None = None, attributes: str = ATTRS) -> DataFrame:
    """Dispatch every raw record by entity type in one pass; unknown types emit nothing.

    ``attributes`` is the part of ``ATTRS`` to be read, as in ``spark.read.schema``:
    payloads are parsed for these and the plain columns.
    """
    chosen = kinds or ENTITY_KINDS
    src = bronze.where(F.col("entity_type").isin(chosen)) if kinds else bronze
    table = _api_events(F.lit(as_of).cast("timestamp"), _item_fields(attributes))
    cells = [((F.col("entity_type") == k) & cond, e) for k in chosen for cond, e in table[k]]
    parsed = parse_payload(src, payload_schema(attributes)).withColumn("_key", safe_text("p.Id"))
    return fan_out(parsed, *cells, attributes=attributes, turns=[i for k in chosen for i in range(len(table[k]))])


def skipped_records(bronze: DataFrame) -> DataFrame:
    """Records that cannot produce an event, counted per entity type and reason."""
    known = F.col("entity_type").isin(ENTITY_KINDS)
    no_id = safe_text(F.get_json_object("raw_payload", "$.Id")).isNull()
    return bronze.withColumn("reason", F.when(~known, "unknown_entity_type").when(no_id, "missing_id")) \
        .where("reason is not null").groupBy("entity_type", "reason").agg(F.count("*").alias("records"))


def invoice_events(bronze, as_of):
    return to_silver(bronze, as_of, ["Invoice"])


def payment_events(bronze, as_of):
    return to_silver(bronze, as_of, ["Payment"])


def bill_events(bronze, as_of):
    return to_silver(bronze, as_of, ["Bill"])


def bill_payment_events(bronze, as_of):
    return to_silver(bronze, as_of, ["BillPayment"])


def credit_events(bronze, as_of):
    return to_silver(bronze, as_of, ["CreditMemo"])


def refund_events(bronze, as_of):
    return to_silver(bronze, as_of, ["RefundReceipt"])


def customer_events(bronze, as_of):
    return to_silver(bronze, as_of, ["Customer"])


def po_events(bronze, as_of):
    return to_silver(bronze, as_of, ["PurchaseOrder"])


def order_file_events(orders: DataFrame, items: DataFrame, reviews: DataFrame | None = None, source: str = "orders_file",
                      currency: str = "BRL") -> DataFrame:
    """Order files -> order_placed / order_delivered / order_late (and review_submitted).

    The item side is reduced to one row per order before the join.
    """
    totals = items.groupBy("order_id").agg(
        F.sum("price").alias("price"), F.sum("freight_value").alias("freight"),
        F.min_by("seller_id", "order_item_id").alias("seller_id"))
    o = orders.join(totals, "order_id", "left").withColumn("source", F.lit(source)).withColumn("ingested_at", F.lit(None).cast("timestamp"))
    key, customer = safe_text("order_id"), safe_text("customer_id")
    bought, delivered = safe_time("order_purchase_timestamp"), safe_time("order_delivered_customer_date")
    promised = safe_time("order_estimated_delivery_date")
    total = F.col("price") + F.col("freight")
    amount = F.when(total >= 0, total)
    related = {"customer": customer, "vendor": safe_text("seller_id")}
    days = lambda a, b: (F.unix_timestamp(a) - F.unix_timestamp(b)) / 86400.0
    ok = key.isNotNull() & bought.isNotNull()
    out = fan_out(
        o,
        (ok, make_event("order_placed", bought, "order", key, related=related, amount=amount, currency=currency,
                              flags=_flags((customer.isNull(), "missing_customer_id"), (amount.isNull(), "missing_amount")),
                              seller_id=safe_text("seller_id"))),
        (ok & delivered.isNotNull(), make_event("order_delivered", delivered, "order", key, related=related, amount=amount,
                                                      currency=currency, delivery_days=days(delivered, bought))),
        (ok & (delivered > promised), make_event("order_late", delivered, "order", key, related=related, amount=amount,
                                                       currency=currency, days_late=days(delivered, promised))))
    return out.unionByName(review_file_events(reviews, source, currency)) if reviews is not None else out


def review_file_events(reviews: DataFrame, source: str = "orders_file", currency: str = "BRL") -> DataFrame:
    r = reviews.withColumn("source", F.lit(source)).withColumn("ingested_at", F.lit(None).cast("timestamp"))
    key, order, score, at = safe_text("review_id"), safe_text("order_id"), safe_number("review_score"), safe_time("review_creation_date")
    bad = F.coalesce((score < 1) | (score > 5), F.lit(True))
    return fan_out(r, (key.isNotNull() & order.isNotNull() & at.isNotNull(), make_event(
        "review_submitted", at, "order", key, entity_kind="review", related={"order": order}, currency=currency,
        flags=_flags((bad, "invalid_review_score")), score=score, comment=safe_text("review_comment_message"))))


def churn_file_events(df: DataFrame, snapshot: str, source: str = "churn_file") -> DataFrame:
    """Churned customers of a snapshot; negative charges become NULL and are flagged."""
    d = df.withColumn("source", F.lit(source)).withColumn("ingested_at", F.lit(None).cast("timestamp"))
    key = safe_text("customer_id")
    churned = F.lower(safe_text("churn")).isin("yes", "1", "true", "churned", "y")
    tenure, monthly, total = safe_number("tenure"), safe_number("monthly_charges"), safe_number("total_charges")
    flags = _flags((tenure.isNull(), "missing_tenure"), (monthly.isNull(), "missing_monthly_charges"),
                   (total.isNull(), "missing_total_charges"), (monthly < 0, "invalid_monthly_charges"), (total < 0, "invalid_total_charges"))
    return fan_out(d, (key.isNotNull() & churned, make_event(
        "customer_churned", F.lit(snapshot).cast("timestamp"), "customer", key, amount=F.when(total >= 0, total), flags=flags,
        tenure=tenure, contract_type=safe_text("contract_type"), monthly_charges=F.when(monthly >= 0, monthly),
        total_charges=F.when(total >= 0, total))))


def shipment_file_events(df: DataFrame, source: str = "shipments_file") -> DataFrame:
    """Late shipments and the purchase orders behind them."""
    d = df.withColumn("source", F.lit(source)).withColumn("ingested_at", F.lit(None).cast("timestamp"))
    ship, order, vendor = safe_text("shipment_id"), safe_text("order_id"), safe_text("vendor_id")
    key = F.coalesce(ship, order)
    expected, actual = safe_time("expected_delivery"), safe_time("actual_delivery")
    amount, placed = safe_number("amount"), F.coalesce(safe_time("shipment_date"), safe_time("expected_delivery"))
    related = {"order": order, "vendor": vendor}
    return fan_out(
        d,
        (key.isNotNull() & (actual > expected), make_event(
            "shipment_delayed", actual, "order", key, entity_kind="shipment", related=related, amount=amount,
            flags=_flags((safe_text("carrier").isNull(), "missing_carrier"),
                         (safe_text("origin").isNull() | safe_text("destination").isNull(), "missing_location_data")),
            carrier=safe_text("carrier"), days_delayed=(F.unix_timestamp(actual) - F.unix_timestamp(expected)) / 86400.0)),
        (order.isNotNull() & vendor.isNotNull() & placed.isNotNull(), make_event(
            "purchase_order_placed", placed, "order", order, related=related, amount=amount,
            flags=_flags((F.coalesce(amount, F.lit(0.0)) == 0, "missing_amount"), (safe_text("line_items").isNull(), "missing_line_items")))))


def ticket_file_events(df: DataFrame, source: str = "tickets_file") -> DataFrame:
    """Opened tickets, and closed ones with their resolution time in hours."""
    d = df.withColumn("source", F.lit(source)).withColumn("ingested_at", F.lit(None).cast("timestamp"))
    key, customer = safe_text("ticket_id"), safe_text("customer_id")
    opened, closed = safe_time("created_at"), safe_time("closed_at")
    ok, related = key.isNotNull() & opened.isNotNull(), {"customer": customer}
    hours = F.when(closed > opened, F.round((F.unix_timestamp(closed) - F.unix_timestamp(opened)) / 3600.0, 2))
    return fan_out(
        d,
        (ok, make_event("support_ticket_opened", opened, "ticket", key, related=related, subject=safe_text("subject"), flags=_flags(
            (customer.isNull(), "missing_customer_id"), (safe_text("category").isNull(), "missing_category"),
            (safe_text("priority").isNull(), "missing_priority")))),
        (ok & closed.isNotNull(), make_event(
            "support_ticket_closed", closed, "ticket", key, related=related, resolution_time_hours=hours,
            satisfaction_score=safe_number("satisfaction_score"),
            flags=_flags((hours.isNull(), "invalid_resolution_time"), (safe_number("satisfaction_score").isNull(), "missing_satisfaction_score")))))
