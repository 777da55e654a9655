"""The audit keeps the fields that it reads, not whole payloads."""

from checks import raw


def test_kept_fields(spark):
    rows = [("Invoice", '{"Id": "1", "TotalAmt": 5.0, "CustomerRef": {"value": "c"}, "Line": [{"LinkedTxn": [{"TxnId": "x"}]}]}'),
            ("Payment", '{"Id": "2", "TotalAmt": 5.0, "Line": [{"LinkedTxn": [{"TxnId": "1"}, {"TxnId": "J"}]}]}'),
            ("Bill", '{"Id": "3", "VendorRef": {"value": "v"}}'), ("Customer", '{"Id": null}'), ("RefundReceipt", '{"Id": "5"}')]
    out = raw._audited_fields(spark.createDataFrame(rows, "entity_type string, raw_payload string"))
    assert out.columns == ["entity_type", "Id", "customer", "vendor", "TotalAmt", "linked"]
    got = {r.entity_type: tuple(r)[1:] for r in out.collect()}
    assert got == {"Invoice": ("1", "c", None, 5.0, None), "Payment": ("2", None, None, 5.0, ["1", "J"]), "Bill": ("3", None, "v", None, None),
                   "Customer": (None, None, None, None, None)}
