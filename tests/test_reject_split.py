"""The reject split of all entity types parses the raw records once."""

import datetime as dt

from checks import raw
from checks.shared import reset


def test_records_are_parsed_once_for_both_sides(spark, tmp_path):
    day = dt.datetime(1996, 1, 2)
    tables = {
        "orders": ([(i, i % 7 + 1, "F" if i % 2 else "O", 20.0 * i, day, "1-URGENT") for i in range(1, 40)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": ([(i, 1, 1, 1, "F", "R", 15.0 * i, day) for i in range(1, 40)],
                     "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_linestatus string, l_returnflag string, l_extendedprice double, l_shipdate timestamp"),
        "customer": ([(1, "c", 5.0)], "c_custkey long, c_name string, c_acctbal double"), "nation": ([(1,)], "n_nationkey long")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    reset()
    out = raw.QUERIES["q4_reject_split_whole"](spark, str(tmp_path))
    assert "from_json" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.event_type, r.reason): r.n for r in out.collect()}
    assert sum(n for (kind, _), n in got.items() if kind == "expense_posted") == 39
    assert got[("expense_posted", "invalid_currency")] == sum(15 * i % 10 == 0 for i in range(1, 40))
