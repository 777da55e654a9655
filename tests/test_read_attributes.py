"""A reader that names attributes has payloads parsed for these alone, with the events and values of a whole parse."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.operators import quality, silver
from panelwise.sources.raw import PAYLOAD

_LINES = ('[{"DetailType": "SalesItemLineDetail", "Description": "d", "Amount": 4.0, "SalesItemLineDetail": {"Qty": 1.0, "ItemRef": {"value": "i"}}},'
          ' {"DetailType": null, "Amount": 1.0}, {"DetailType": "SubTotalLineDetail", "Amount": 5.0}]')
_ROWS = [
    ("Invoice", '{"Id": "1", "TotalAmt": 5.0, "Balance": 0.0, "TxnDate": "2020-01-01", "MetaData": {"LastUpdatedTime": "2020-02-01T00:00:00Z"}, "Line": %s}' % _LINES),
    ("Invoice", '{"Id": "2", "TotalAmt": 7.0, "Balance": 8.0, "TxnDate": "2020-01-01", "DueDate": "2020-01-05", "CustomerRef": {"value": "c"}, "Line": %s}' % _LINES),
    ("Invoice", '{"Id": "3", "TotalAmt": 7.0, "TxnDate": "no date", "DueDate": "2030-01-05", "DocNumber": {"x": 1}, "Line": 5}'), ("Invoice", '{"Id": " "}'), ("Invoice", "{"), ("Invoice", None),
    ("Bill", '{"Id": "4", "TotalAmt": null, "Line": []}'), ("Bill", '{"Id": "5", "TotalAmt": 2.0, "TxnDate": "2019-01-01", "PaymentType": [], "Line": [null, {"Amount": 2.0}]}'),
    ("Bill", '{"Id": "5", "TotalAmt": 2.0, "TxnDate": "2019-01-01", "PaymentType": [], "Line": [null, {"Amount": 2.0}]}'), ("Estimate", '{"Id": "6"}'), (None, '{"Id": "7"}')]


def _bronze(spark):
    return spark.createDataFrame(_ROWS, "entity_type string, raw_payload string") \
        .select(F.lit("r").alias("record_id"), "entity_type", F.lit("acct").alias("source"), F.lit(None).cast("timestamp").alias("created_at"), "raw_payload")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scores_of_named_attributes(spark):
    kinds = ["Invoice", "Bill"]
    some = quality.with_scores(silver.to_silver(_bronze(spark), "2021-01-01", kinds, quality.SCORED), "2019-06-01")
    whole = quality.with_scores(silver.to_silver(_bronze(spark), "2021-01-01", kinds), "2019-06-01")
    assert some.drop("attributes").schema == whole.drop("attributes").schema
    rows = lambda df: sorted((tuple(r) for r in df.drop("attributes").withColumn("related", F.map_entries("related")).collect()), key=repr)
    assert rows(some) == rows(whole)
    got = sorted((r.source_entity_id, r.event_type, round(r.consistency, 4)) for r in some.collect())
    assert got == [("1", "invoice_issued", 0.6667), ("1", "invoice_paid", 0.0), ("2", "invoice_issued", 0.0), ("2", "invoice_overdue", 0.0), ("3", "invoice_issued", 0.5),
                   ("4", "expense_posted", 0.0), ("5", "expense_posted", 1.0), ("5", "expense_posted", 1.0)]
    plan = _plan(some.groupBy("event_type").agg(F.avg("consistency")))
    assert "Line,ArrayType" in plan
    assert not any(n in plan for n in ("DocNumber", "PaymentMethodRef", "LinkedTxn", "ItemRef", "Description"))


def test_events_are_counted_without_lambdas(spark):
    counts = silver.to_silver(_bronze(spark), "2021-01-01").groupBy("event_type").count()
    assert "lambda" not in _plan(counts)
    assert {tuple(r) for r in counts.collect()} == {("invoice_issued", 3), ("invoice_paid", 1), ("invoice_overdue", 1), ("expense_posted", 3)}


def test_all_attributes_need_the_whole_payload():
    assert silver.payload_schema(silver.ATTRS) == T.StructType.fromDDL(PAYLOAD)
