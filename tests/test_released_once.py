"""A micro-batch of the alert stream: its stateful stage runs once, and an empty one carries the last alerts on."""

from pyspark.sql import functions as F

from panelwise.streaming import suppression


def test_released_alerts_are_computed_once(spark, tmp_path):
    count = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        count.add(1)
        return x
    hour = 3600 * 1_000_000
    alerts = spark.range(20).select(seen("id").alias("alert_id"), (F.col("id") % 2).alias("monitor_id"), (F.col("id") * hour).alias("at"))
    suppression.link(alerts, 0, str(tmp_path), 4)
    assert count.value == 20
    first = {(r.alert_id, r.monitor_id) for r in suppression.emitted(spark, str(tmp_path)).collect()}
    assert first == {(i, i % 2) for i in (0, 4, 8, 12, 16, 1, 5, 9, 13, 17)}
    suppression.link(alerts.where("false"), 1, str(tmp_path), 4)
    suppression.link(spark.range(1).select(F.lit(30).cast("long").alias("alert_id"), F.lit(0).cast("long").alias("monitor_id"), F.lit(19 * hour).alias("at")), 2, str(tmp_path), 4)
    assert {(r.alert_id, r.monitor_id) for r in suppression.emitted(spark, str(tmp_path)).collect()} == first  # 3 hours after alert 16: it was not forgotten
