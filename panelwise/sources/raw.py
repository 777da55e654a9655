"""Reading and writing of raw (bronze), canonical (silver), metric (gold) and incident tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAYLOAD = (
    "Id string, DocNumber string, TxnDate string, DueDate string, ShipDate string, TotalAmt double, Balance double, "
    "DisplayName string, PaymentType string, CurrencyRef struct<value:string>, CustomerRef struct<value:string>, "
    "VendorRef struct<value:string>, PaymentMethodRef struct<name:string,value:string>, "
    "CustomerMemo struct<value:string>, PrimaryEmailAddr struct<Address:string>, "
    "MetaData struct<CreateTime:string,LastUpdatedTime:string>, "
    "Line array<struct<DetailType:string,Description:string,Amount:double,"
    "LinkedTxn:array<struct<TxnId:string,TxnType:string>>,"
    "SalesItemLineDetail:struct<Qty:double,ItemRef:struct<value:string>>,"
    "ItemBasedExpenseLineDetail:struct<Qty:double,ItemRef:struct<value:string>>,"
    "AccountBasedExpenseLineDetail:struct<AccountRef:struct<name:string,value:string>>>>"
)
NOTIFICATION = (
    "eventNotifications array<struct<realmId:string,dataChangeEvent:struct<entities:array<"
    "struct<name:string,id:string,operation:string,lastUpdated:string>>>>>"
)

# --- column aliases accepted per logical field (fixed values) -----------------
SHIPMENT_ALIASES = {
    "shipment_id": ["shipment_id", "tracking_id", "tracking_number", "shipment_number", "delivery_id"],
    "order_id": ["order_id", "purchase_order", "po_number", "order_number"],
    "carrier": ["carrier", "shipping_carrier", "courier", "transporter"],
    "route": ["route", "shipping_route", "origin_destination", "lane"],
    "origin": ["origin", "source", "pickup_location", "from_location"],
    "destination": ["destination", "delivery_location", "to_location", "destination_city"],
    "expected_delivery": ["expected_delivery", "scheduled_delivery", "planned_delivery", "eta", "estimated_delivery_date"],
    "actual_delivery": ["actual_delivery", "delivered_date", "actual_delivery_date", "delivery_date"],
    "shipment_date": ["shipment_date", "shipped_date", "dispatch_date", "pickup_date"],
    "vendor_id": ["vendor_id", "supplier_id", "vendor", "supplier"],
    "amount": ["amount", "total_amount", "order_value", "po_value"],
    "line_items": ["line_items", "items", "products", "item_count"],
}
CHURN_ALIASES = {
    "customer_id": ["customerID", "customer_id", "CustomerID", "ID", "customer"],
    "churn": ["Churn", "churn", "Churned", "churned", "Attrition"],
    "tenure": ["tenure", "Tenure", "tenure_months", "months_active"],
    "contract_type": ["Contract", "contract", "contract_type", "ContractType", "subscription_type"],
    "monthly_charges": ["MonthlyCharges", "monthly_charges", "monthly_fee", "MonthlyFee"],
    "total_charges": ["TotalCharges", "total_charges", "total_revenue", "TotalRevenue"],
}
TICKET_ALIASES = {
    "ticket_id": ["ticket_id", "id", "ticket_number", "case_id", "case_number"],
    "customer_id": ["customer_id", "user_id", "client_id", "requester_id"],
    "created_at": ["created_at", "created_date", "creation_date", "opened_at", "submitted_at", "timestamp"],
    "closed_at": ["closed_at", "closed_date", "resolved_at", "resolution_date", "completed_at"],
    "status": ["status", "state", "ticket_status", "case_status"],
    "category": ["category", "type", "ticket_type", "issue_type", "department"],
    "priority": ["priority", "severity", "urgency"],
    "channel": ["channel", "source", "origin", "contact_method"],
    "subject": ["subject", "title", "summary", "description"],
    "satisfaction_score": ["satisfaction_score", "csat", "rating", "customer_rating", "feedback_score"],
}


def safe_text(c: Column | str) -> Column:
    """Trimmed text; blank counts as missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def safe_number(c: Column | str) -> Column:
    return safe_text(c).try_cast("double")


def safe_time(c: Column | str) -> Column:
    """Timestamp or NULL; ISO text with or without a time part and zone."""
    return safe_text(c).try_cast("timestamp")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a declared schema; values that do not fit their type become NULL."""
    target = T.StructType.fromDDL(schema)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in target])
    raw = spark.read.schema(text).option("header", True).csv(path)
    return raw.select(*[
        (safe_time(f.name) if isinstance(f.dataType, T.TimestampType) else safe_text(f.name).try_cast(f.dataType)).alias(f.name)
        for f in target])


def resolve_columns(df: DataFrame, aliases: dict[str, list[str]], required: list[str] = ()) -> DataFrame:
    """Rename the first existing alias of each logical field; absent optional fields become NULL."""
    picked = {field: next((n for n in names if n in df.columns), None) for field, names in aliases.items()}
    missing = [f for f in required if picked.get(f) is None]
    if missing:
        raise ValueError(f"required columns not found: {', '.join(missing)}")
    return df.select(*[
        (F.col(f"`{name}`") if name else F.lit(None).cast("string")).alias(field) for field, name in picked.items()])


def write_bronze(df: DataFrame, path: str) -> None:
    """Append raw records; one folder per entity type so reads prune."""
    df.write.mode("append").partitionBy("entity_type").option("compression", "zstd").option("parquet.compression.codec.zstd.level", 1).parquet(path)


def read_bronze(bronze: DataFrame, source: str | None = None, entity_type: str | None = None,
                since: str | None = None, limit: int | None = None) -> DataFrame:
    out = bronze
    if source:
        out = out.where(F.col("source") == source)
    if entity_type:
        out = out.where(F.col("entity_type") == entity_type)
    if since:
        out = out.where(F.col("created_at") >= F.lit(since).cast("timestamp"))
    return out.orderBy(F.desc("created_at"), "record_id").limit(limit) if limit else out


def incremental(df: DataFrame, high_water_mark: str, column: str = "created_at") -> DataFrame:
    """Only rows newer than the last synchronised timestamp."""
    return df.where(F.col(column) > F.lit(high_water_mark).cast("timestamp"))


def latest_entities(bronze: DataFrame) -> DataFrame:
    """Last record per entity; entities whose last operation removes them are dropped.

    A grouped ``max_by`` combines on the map side, so a hot entity is reduced
    before the shuffle (a ranking window would ship all its versions).
    """
    payload = [c for c in bronze.columns if c not in ("entity_type", "entity_id")]
    last = bronze.groupBy("entity_type", "entity_id").agg(
        F.max_by(F.struct(*payload), F.struct("created_at", "record_id")).alias("r"))
    return last.where(~F.col("r.operation").isin("Delete", "Void")).select("entity_type", "entity_id", "r.*")


def merge_silver(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New events not stored yet, one row per event id."""
    return new.dropDuplicates(["event_id"]).join(existing.select("event_id"), "event_id", "left_anti")


def append_silver(new: DataFrame, existing: DataFrame, path: str) -> None:
    merge_silver(new, existing).withColumn("event_date", F.to_date("event_time")) \
        .write.mode("append").partitionBy("event_date").parquet(path)


def read_events(ev: DataFrame, event_types: list[str] | None = None, source: str | None = None, lo: str | None = None,
                hi: str | None = None, entity_id: str | None = None, limit: int | None = None) -> DataFrame:
    out = ev
    if event_types:
        out = out.where(F.col("event_type").isin(event_types))
    if source:
        out = out.where(F.col("source") == source)
    if lo:
        out = out.where(F.col("event_time") >= F.lit(lo).cast("timestamp"))
    if hi:
        out = out.where(F.col("event_time") <= F.lit(hi).cast("timestamp"))
    if entity_id:
        out = out.where(F.col("entity_id") == entity_id)
    return out.orderBy("event_time", "event_id").limit(limit) if limit else out


def append_gold(gold: DataFrame, path: str) -> None:
    gold.write.mode("append").partitionBy("metric_name").parquet(path)


def read_gold(gold: DataFrame, names: list[str] | None = None, lo: str | None = None, hi: str | None = None) -> DataFrame:
    out = gold
    if names:
        out = out.where(F.col("metric_name").isin(names))
    if lo:
        out = out.where(F.col("metric_date") >= F.lit(lo).cast("date"))
    if hi:
        out = out.where(F.col("metric_date") <= F.lit(hi).cast("date"))
    return out


def read_incidents(inc: DataFrame, incident_type: str | None = None, severity: str | None = None, status: str | None = None,
                   lo: str | None = None, hi: str | None = None) -> DataFrame:
    out = inc
    for column, value in (("incident_type", incident_type), ("severity", severity), ("status", status)):
        if value:
            out = out.where(F.col(column) == value)
    if lo:
        out = out.where(F.col("detected_at") >= F.lit(lo).cast("timestamp"))
    if hi:
        out = out.where(F.col("detected_at") <= F.lit(hi).cast("timestamp"))
    return out


def explode_notifications(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per changed entity of a webhook body; notifications without a realm are skipped."""
    n = df.withColumn("_n", F.explode(F.from_json(payload, NOTIFICATION)["eventNotifications"])).where("_n.realmId is not null")
    e = n.withColumn("_e", F.explode("_n.dataChangeEvent.entities"))
    return e.select(*[c for c in df.columns if c != payload], F.col("_n.realmId").alias("realm_id"),
                    F.col("_e.name").alias("entity_type"), F.col("_e.id").alias("entity_id"),
                    F.col("_e.operation").alias("operation"), safe_time("_e.lastUpdated").alias("last_updated")) \
        .where("last_updated is not null")


def _issue(name: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures")


def audit_dataset(invoices: DataFrame, bills: DataFrame, payments: DataFrame, customers: DataFrame,
                  vendors: DataFrame, items: DataFrame) -> DataFrame:
    """Completeness, orphan references and payment consistency; one row per check.

    Invoices carry (Id, customer, TotalAmt), bills (vendor), payments
    (TotalAmt, linked: array of transaction ids), the rest at least ``Id``.
    """
    required = {"Vendor": vendors, "Customer": customers, "Item": items, "Invoice": invoices, "Payment": payments, "Bill": bills}
    empty = None
    for name, df in required.items():
        one = df.agg(F.when(F.count("*") == 0, 1).otherwise(0).alias("e"))
        empty = one if empty is None else empty.unionByName(one)
    complete = empty.agg(F.sum("e").alias("failures")).select(F.lit("completeness").alias("check"), "failures")
    orphan_inv = invoices.where("customer is not null").join(customers, F.col("customer") == customers["Id"], "left_anti")
    orphan_bill = bills.where("vendor is not null").join(vendors, F.col("vendor") == vendors["Id"], "left_anti")
    linked = payments.select(F.col("TotalAmt").alias("paid"), F.explode("linked").alias("_id"))
    off = linked.join(invoices.select(F.col("Id").alias("_id"), "TotalAmt"), "_id").where(F.abs(F.col("paid") - F.col("TotalAmt")) > 0.01)
    checks = complete.unionByName(_issue("invoice_customer_integrity", orphan_inv)) \
        .unionByName(_issue("bill_vendor_integrity", orphan_bill)) \
        .unionByName(_issue("payment_amount_consistency", off))
    done = checks.withColumn("passed", F.col("failures") == 0)
    return done.withColumn("quality_score", F.avg(F.col("passed").cast("int")).over(W.partitionBy()))


def profile(orders: DataFrame, payments: DataFrame, sellers: DataFrame, products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Dataset statistics as (statistic, value) rows.

    orders(order_id, customer_id, status, purchased_at), payments(order_id,
    payment_type, payment_value), reviews(review_score).
    """

    def rows(df: DataFrame, **stats: Column) -> DataFrame:
        wide = df.agg(*[c.cast("string").alias(n) for n, c in stats.items()])
        return wide.unpivot([], list(stats), "statistic", "value")

    def shares(df: DataFrame, column: str, prefix: str) -> DataFrame:
        return df.groupBy(column).agg(F.count("*").cast("string").alias("value")) \
            .select(F.concat(F.lit(prefix + ":"), F.col(column)).alias("statistic"), "value")
    per_order = payments.groupBy("order_id").agg(F.sum("payment_value").alias("v"))
    out = rows(orders, total_orders=F.count("*"), total_customers=F.count_distinct("customer_id"),
               first_day=F.to_date(F.min("purchased_at")), last_day=F.to_date(F.max("purchased_at")),
               null_customers=F.count_if(F.col("customer_id").isNull()))
    for part in (rows(per_order, total_revenue=F.round(F.sum("v"), 2).cast("decimal(38,2)"), avg_order_value=F.round(F.avg("v"), 2).cast("decimal(38,2)")),
                 rows(sellers, total_sellers=F.count("*")), rows(products, total_products=F.count("*")),
                 rows(reviews, total_reviews=F.count("*"), avg_review_score=F.round(F.avg("review_score"), 4).cast("decimal(38,4)")),
                 shares(orders, "status", "status"), shares(payments, "payment_type", "payment")):
        out = out.unionByName(part)
    return out


def null_shares(df: DataFrame, table: str) -> DataFrame:
    """(table, column, nulls, rows, share) for every column, from one pass; NaN counts as a value, the share of an empty table is null."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_n{i}") for i, c in enumerate(df.columns)])
    return counts.select("_rows", F.inline(F.array(*[
        F.struct(F.lit(table).alias("table"), F.lit(c).alias("column"), (F.col("_rows") - F.col(f"_n{i}")).alias("nulls")) for i, c in enumerate(df.columns)]))) \
        .select("table", "column", "nulls", F.col("_rows").alias("rows"), F.try_divide("nulls", F.col("_rows")).alias("share"))
