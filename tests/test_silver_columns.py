"""A query over silver events computes only the columns that it reads."""

from pyspark.sql import functions as F

from panelwise.operators import silver


def test_columns_not_read_are_not_computed(spark):
    rows = [("Invoice", '{"Id": "1", "TotalAmt": 5.0, "Balance": 0.0, "TxnDate": "2020-01-01", "Line": [{"DetailType": "SalesItemLineDetail", "Amount": 5.0}]}'),
            ("Invoice", '{"Id": "2", "TotalAmt": 7.0, "Balance": 7.0, "TxnDate": "2020-01-01", "DueDate": "2020-01-05"}'),
            ("Bill", '{"Id": "3", "TotalAmt": 2.0}'), ("Bill", '{"TotalAmt": 2.0}'), ("Estimate", '{"Id": "4"}')]
    bronze = spark.createDataFrame(rows, "entity_type string, raw_payload string") \
        .select(F.lit("r").alias("record_id"), "entity_type", F.lit("acct").alias("source"), F.lit(None).cast("timestamp").alias("created_at"), "raw_payload")
    events = silver.to_silver(bronze, "2021-01-01")
    got = sorted((r.event_type, r.amount, r.source_entity_id) for r in events.collect())
    assert got == [("expense_posted", 2.0, "3"), ("invoice_issued", 5.0, "1"), ("invoice_issued", 7.0, "2"), ("invoice_overdue", 7.0, "2"), ("invoice_paid", 5.0, "1")]
    assert len(events.where("event_type = 'invoice_issued' AND source_entity_id = '1'").first().attributes.line_items) == 1
    totals = events.groupBy("event_type").agg(F.sum("amount"))
    plan = totals._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries" not in plan and "DetailType" not in plan.split("from_json")[0]
