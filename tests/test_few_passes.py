"""Events are read once for everything daily, and what is read is taken apart without lambdas; small dictionaries are broadcast."""

from pyspark.sql import functions as F

from panelwise.operators import blast, daily, features
from panelwise.sources import star


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _events(spark):
    day = F.expr("timestamp '2020-01-01 10:00:00'")
    rows = [("invoice_paid", "customer", "c1", {"customer": "c1"}, 5.0), ("invoice_paid", "customer", "c1", {"customer": "c2"}, 7.0), ("refund_issued", "customer", None, {"Customer": "c3", "vendor": None}, 2.0),
            ("invoice_paid", None, "c4", None, None), ("order_placed", "Order", "o1", {"order": "o2"}, 1.0), (None, "order", "o3", {}, 9.0)]
    return spark.createDataFrame(rows, "event_type string, entity_type string, entity_id string, related map<string,string>, amount double") \
        .withColumn("event_time", day).withColumn("attributes", F.expr(f"named_struct({', '.join(repr(n) + ', cast(null as double)' for n in daily.MEASURED)})"))


def test_customers_of_events(spark):
    people = daily.customer_days(_events(spark))
    assert "lambda" not in _plan(people)
    assert {(r.customer, None if r.paid is None else float(r.paid)) for r in people.collect()} == {("c1", 5.0), ("c2", 7.0)}


def test_entities_of_events(spark):
    seen = blast.entity_days(_events(spark))
    assert "lambda" not in _plan(seen)
    assert {(r.kind, r.entity) for r in seen.collect()} == {("customer", "c1"), ("customer", "c2"), ("customer", "c3"), (None, "c4"), ("Order", "o1"), ("order", "o2"), ("order", "o3")}


def test_daily_sums_come_from_sums_per_type(spark):
    ev = _events(spark)
    one = daily.daily_base(ev).first()
    assert (one.revenue, one.refunds, one.placed, one.late, one.late_days, one.pay_days, one.pay_n) == (12.0, 2.0, 1, 0, None, None, 0)
    assert daily.daily_of(daily.type_days(ev)).first() == one


def test_texts_of_a_line_are_made_once(spark, tmp_path):
    spark.sql("select 1L l_orderkey, 2L l_partkey, 3L l_suppkey, 1 l_linenumber, 1D l_quantity, 10D l_extendedprice, 0.1D l_discount, 0.2D l_tax, 'R' l_returnflag, 'F' l_linestatus,"
              " timestamp_ntz '2020-01-01 00:00:00' l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    ev = star.ledger_events(spark, str(tmp_path))
    assert _plan(ev.select("entity_id")).count("concat_ws(:, vendor") == 0
    assert "lambda" not in _plan(ev)
    assert {(r.event_type, r.entity_id, r.related.get("vendor")) for r in ev.collect()} == {
        ("expense_posted", "expense:shop:1-1-2-3-18262", "vendor:shop:3"), ("expense_paid", "expense:shop:1-1-2-3-18262", "vendor:shop:3"), ("refund_issued", "payment:shop:1-1-2-3-18262", None)}


def test_small_dictionary_is_broadcast(spark):
    rows = spark.range(100_000).select(F.concat(F.lit("k"), F.col("id") % 700).alias("c"), "id")
    coded = features.label_code(rows, "c", "code")
    plan = _plan(coded)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    names = sorted({f"k{i}" for i in range(700)})
    assert {(r.c, r.code) for r in coded.select("c", "code").distinct().collect()} == {(n, i) for i, n in enumerate(names)}
