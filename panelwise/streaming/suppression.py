"""Alert suppression on a stream, in event time and without a group per monitor.

State is sharded by (monitor, time bucket of the suppression span). A shard
holds its alerts until the watermark has passed the end of its bucket; an
event-time timer then releases them, so alerts that arrive out of order are
judged in the order in which they happened. A bucket holds at most one alert
that passes, and buckets are linked by the batch operator's successor jumps
from each monitor's last alert that passed: no task sees the alerts of a whole
monitor, and the driver none.

Defined results: alerts later than the watermark when they arrive do not pass,
since the alerts after them have been judged (``late.LateAware`` over the same
source keeps them); alerts without a time or monitor neither; of alerts at the
same time the smallest id passes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from panelwise import config
from panelwise.operators import monitors
from panelwise.session import written

SHARDS = "spark.sql.shuffle.partitions"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RELEASED = "monitor_id long, alert_id long, at long"
EMITTED = "alert_id long, monitor_id long, at long"


class Hold(StatefulProcessor):
    """Holds the alerts of one (monitor, bucket) until its timer at the bucket's end."""

    def __init__(self, span_us: int) -> None:
        self.span_us = span_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alerts = handle.getListState("alerts", "alert_id long, at long")
        self.ends = handle.getValueState("ends", "ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        if not self.ends.exists():
            end = -(-((key[1] + 1) * self.span_us) // 1000)
            self.ends.update((end,))
            self.handle.registerTimer(end)
        for row in rows:
            self.alerts.appendValue((row.alert_id, row.at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        held = [Row(monitor_id=key[0], alert_id=a[0], at=a[1]) for a in self.alerts.get()]
        self.alerts.clear()
        self.ends.clear()
        return iter(held)

    def close(self) -> None:
        pass


def released(alerts: DataFrame, hours: float = config.SUPPRESSION_HOURS, delay: str = "1 day") -> DataFrame:
    """Alerts (alert_id, monitor_id, triggered_at) whose bucket is closed, in append mode."""
    span = int(hours * 3600 * 1_000_000)
    # one condition on the event time, so that it is not pushed below the watermark: heartbeats without a monitor count there
    whole = F.when(F.col("triggered_at").isNotNull(), F.col("monitor_id")).isNotNull()
    marked = alerts.withWatermark("triggered_at", delay).where(whole).select("monitor_id", "alert_id", "triggered_at", F.unix_micros("triggered_at").alias("at"))
    return marked.withColumn("bucket", F.floor(F.col("at") / span)).groupBy("monitor_id", "bucket").transformWithState(
        Hold(span), RELEASED, "Append", "EventTime")


def _table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch int").parquet(f"{root}/{name}")


def link(df: DataFrame, batch: int, root: str, hours: float = config.SUPPRESSION_HOURS) -> None:
    """Judge the alerts that a micro-batch released: ``emitted`` gets those that pass, ``last`` every monitor's latest one."""
    spark = df.sparkSession
    out, kept = f"{root}/emitted/batch={batch}", f"{root}/last/batch={batch}"
    now = written(df.select("alert_id", "monitor_id", "at"), "released")  # every other use would run the stateful stage again
    if batch:
        last = _table(spark, root, "last", EMITTED).where(F.col("batch") == batch - 1).drop("batch")
        if now.isEmpty():
            last.limit(0).write.mode("overwrite").parquet(out)
            last.select("alert_id", "monitor_id", "at").write.mode("overwrite").parquet(kept)
            return
        now = now.withColumn("old", F.lit(False)).unionByName(last.join(now.select("monitor_id").distinct(), "monitor_id").withColumn("old", F.lit(True)))
    else:
        now = now.withColumn("old", F.lit(False))
    judged = monitors.suppress(now.withColumn("triggered_at", F.timestamp_micros("at")), hours)
    judged.where("NOT suppressed AND NOT old").select("alert_id", "monitor_id", "at").write.mode("overwrite").parquet(out)
    latest = spark.read.schema(EMITTED).parquet(out)
    if batch:
        latest = latest.unionByName(last)
    latest.groupBy("monitor_id").agg(F.max_by("alert_id", "at").alias("alert_id"), F.max("at").alias("at")) \
        .select("alert_id", "monitor_id", "at").write.mode("overwrite").parquet(kept)


def run(alerts: DataFrame, root: str, hours: float = config.SUPPRESSION_HOURS, delay: str = "1 day", shards: int | None = None) -> None:
    """Take all alerts that are available; the next call goes on from the checkpoint.

    Every shard of the state opens its store and a Python worker in every
    batch, so unless ``shards`` says otherwise there is one per core. A stream
    keeps the number it was first started with.
    """
    spark = alerts.sparkSession
    before, width = spark.conf.get(PROVIDER), spark.conf.get(SHARDS)
    spark.conf.set(PROVIDER, ROCKSDB)  # timers and lists need it; a query keeps what it was started with
    spark.conf.set(SHARDS, str(shards or min(int(width), spark.sparkContext.defaultParallelism)))
    try:
        query = released(alerts, hours, delay).writeStream.outputMode("append").option("checkpointLocation", f"{root}/checkpoint") \
            .foreachBatch(lambda df, batch: link(df, batch, root, hours)).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
        spark.conf.set(SHARDS, width)


def emitted(spark: SparkSession, root: str) -> DataFrame:
    """(alert_id, monitor_id, at) of all alerts that have passed."""
    return _table(spark, root, "emitted", EMITTED).drop("batch")
