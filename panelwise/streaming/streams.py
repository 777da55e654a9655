"""Streaming forms of the ingestion, daily metric and alerting operators.

Every stream runs with ``availableNow`` or continuously on the same code.
Results go to parquet through ``foreachBatch`` writes that replace their own
batch folder, so a replayed batch does not duplicate rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelwise import config
from panelwise.session import shared_folder
from panelwise.sources.star import activity_from

LATE_BANDS = ((1, "same_day"), (7, "week"), (30, "month"))


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """A parquet table (one file or many) as a file stream with its own schema."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def activity_stream(spark: SparkSession, folder: str) -> DataFrame:
    return activity_from(table_stream(spark, folder, "events"))


def dedup_events(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """Drop repeated event ids that arrive within the watermark."""
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])


def daily_windows(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """Count and amount per event type and day."""
    return events.withWatermark("event_time", delay).groupBy(F.window("event_time", "1 day").alias("w"), "event_type") \
        .agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


def sliding_rates(events: DataFrame, delay: str = "2 days", days: int = 7) -> DataFrame:
    """Event counts and amounts over a window of ``days`` that moves by one day."""
    return events.withWatermark("event_time", delay).groupBy(F.window("event_time", f"{days} days", "1 day").alias("w")).agg(
        F.count_if(F.col("event_type") == "support_ticket_opened").alias("opened"), F.count_if(F.col("event_type") == "support_ticket_closed").alias("closed"),
        F.sum(F.when(F.col("event_type") == "payment_received", F.col("amount"))).alias("revenue"))


def suppress_stream(alerts: DataFrame, hours: float = config.SUPPRESSION_HOURS, delay: str = "1 day") -> DataFrame:
    """Alerts that pass suppression; the state per monitor is the last emitted time."""
    span = int(hours * 3600 * 1_000_000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["at", "alert_id"])
        kept = []
        for alert_id, at in zip(rows["alert_id"], rows["at"]):
            if last is None or at - last >= span:
                last = int(at)
                kept.append((int(alert_id), key[0], int(at)))
        if last is not None:
            state.update((last,))
            # forgotten once no alert inside the span can still arrive
            state.setTimeoutTimestamp(max(last // 1000 + span // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(kept, columns=["alert_id", "monitor_id", "at"])
    src = alerts.withWatermark("triggered_at", delay).withColumn("at", F.unix_micros("triggered_at"))
    return src.groupBy("monitor_id").applyInPandasWithState(
        step, "alert_id long, monitor_id long, at long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def late_band(created: str = "ingested_at", event: str = "event_time"):
    days = F.floor((F.unix_micros(created) - F.unix_micros(event)) / 86400e6)
    band = None
    for limit, name in LATE_BANDS:
        band = F.when(days < limit, name) if band is None else band.when(days < limit, name)
    return band.otherwise("late")


def run_now(stream: DataFrame, mode: str, write: Callable[[DataFrame, int, str], None] | None = None) -> str:
    """Run a stream over everything that is available and return the result folder."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{root}/data"

    def default(df: DataFrame, batch: int, path: str) -> None:
        df.withColumn("batch_no", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    sink = write or default
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint") \
        .foreachBatch(lambda df, batch: sink(df, batch, out)).trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def latest_per_key(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Final state of an update-mode stream: the row of the last batch for every key."""
    df = spark.read.parquet(folder)
    rest = [c for c in df.columns if c not in (*keys, "batch", "batch_no")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_no").alias("r")).select(*keys, "r.*")


def split_late(df: DataFrame, batch: int, path: str) -> None:
    """Write a batch to one folder per lateness band; rows beyond the last band go to the side table."""
    df.withColumn("band", late_band()).write.mode("overwrite").partitionBy("band").parquet(f"{path}/batch={batch}")
