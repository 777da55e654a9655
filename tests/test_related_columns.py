"""Views with related entities as columns give what their maps give; trailing distinct entities by bits."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from panelwise.operators import blast, daily
from panelwise.sources import star


def _tables(spark, folder):
    spark.sql("select id o_orderkey, id % 5 o_custkey, if(id % 2 = 0, 'F', 'O') o_orderstatus, 100D + id o_totalprice, cast(date_add(date'1995-01-01', int(id * 7)) as timestamp_ntz) o_orderdate,"
              " array('1-URGENT', '3-MEDIUM', '5-LOW')[id % 3] o_orderpriority from range(20)").write.parquet(f"{folder}/orders.parquet")
    spark.sql("select id % 20 l_orderkey, id % 6 l_partkey, id % 4 l_suppkey, int(id % 3) l_linenumber, 1D l_quantity, 10D l_extendedprice, 0.1D l_discount, 0.2D l_tax, if(id % 3 = 0, 'R', 'N') l_returnflag,"
              " if(id % 2 = 0, 'F', 'O') l_linestatus, cast(date_add(date'1995-01-10', int(id * 11 % 200)) as timestamp_ntz) l_shipdate from range(60)").write.parquet(f"{folder}/lineitem.parquet")
    spark.sql("select id c_custkey, if(id % 2 = 0, -1D, 1D) c_acctbal from range(5)").write.parquet(f"{folder}/customer.parquet")


def test_columns_agree_with_maps_and_ledger_is_not_read_for_customers(spark, tmp_path):
    _tables(spark, tmp_path)
    plain, linked = (star.whole_panel_events(spark, str(tmp_path), linked=x) for x in (False, True))
    for f in (daily.customer_days, blast.entity_days):
        a, b = (sorted(map(str, f(ev).collect())) for ev in (plain, linked))
        assert a == b and a
    plan = daily.customer_days(linked)._jdf.queryExecution().optimizedPlan().toString()
    assert "map(" not in plan and "expense" not in plan


def test_affected_entities_by_brute_force(spark):
    rng, start = random.Random(5), date(1969, 11, 1)
    seen = [(rng.choice(["customer", "order"]), f"e{rng.randrange(12)}", start + timedelta(rng.randrange(400))) for _ in range(150)] + [("customer", "e1", None), ("order", "lost", None)]
    ev = spark.createDataFrame([(k, e, d, {}) for k, e, d in seen], "entity_type string, entity_id string, event_time date, related map<string,string>") \
        .withColumn("event_time", F.col("event_time").cast("timestamp"))
    days = [start + timedelta(i) for i in range(450)]
    spine = spark.createDataFrame([(d,) for d in days], "metric_date date")
    dated = [x for x in seen if x[2]]
    first = min(d for k, e, d in dated if (k, e) == ("customer", "e1"))
    for window in (31, 62):
        frame = blast.affected_by_day(ev, spine, window)
        assert "lead(" not in frame._jdf.queryExecution().optimizedPlan().toString()
        got = {r.metric_date: r for r in frame.collect()}
        for d in days:
            for kind, value in (("customer", got[d].customers_affected), ("order", got[d].orders_affected)):
                want = {e for k, e, x in dated if k == kind and 0 <= (d - x).days < window} | ({"e1"} if kind == "customer" and d < first else set())
                assert value == len(want), (d, kind)
