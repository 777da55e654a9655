"""Streams that lose nothing to their watermark.

A micro-batch is compared with the high-water mark of the batches before it,
as a streaming watermark would be. Rows above the mark are on time; rows below
it go to a side table and correct the daily results they belong to, so that on
time plus late is always everything that arrived. What a batch writes depends
on that batch and earlier ones only, and replaces the batch's own folder:
replayed batches and restarts from the checkpoint neither lose nor repeat rows.

Daily results are kept as partial aggregates per batch and are merged into a
base every ``COMPACT`` batches, so reading them costs the days and kinds, not
the history of batches. Repeated keys are looked up in the days around the
batch's own days only.

Defined results: rows without an event time are late and belong to no day;
a row is a repeat if a row of the same key, with a time at most the delay
away, arrived before; of repeats in one batch the earliest stays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Batches whose partial results are merged into one base.
COMPACT = 32
DAY = 86_400_000_000

Measures = dict[str, Callable[[], Column]]


@dataclass(frozen=True)
class LateAware:
    """One stream's tables below ``root``: rows (on time and late), high-water marks, partial daily results.

    ``measures`` are sums or counts over rows, ``by`` the columns of a daily
    result beside the day, ``keys`` what tells repeats (none: all rows count).
    """

    spark: SparkSession
    root: str
    schema: T.StructType
    delay_days: float
    by: tuple[str, ...]
    measures: Measures
    event_time: str = "event_time"
    keys: tuple[str, ...] = ()
    compact: int = COMPACT
    _added: str = field(default="late boolean, behind_us long, day date, batch int", repr=False)

    # --- tables

    def rows(self, before: int | None = None) -> DataFrame:
        """Every row kept so far with ``late``, ``behind_us`` (how far below the mark) and the number of its batch."""
        added = T.StructType.fromDDL(self._added).fields
        table = self.spark.read.schema(T.StructType([*self.schema.fields, *added])).option("basePath", f"{self.root}/rows").parquet(f"{self.root}/rows")
        return table if before is None else table.where(F.col("batch") < before)

    def late(self) -> DataFrame:
        """The side table: rows that came below the mark."""
        return self.rows().where("late")

    def marks(self) -> DataFrame:
        """(high_us, n, n_late, batch): highest event time and counts of every batch."""
        return self.spark.read.schema("high_us long, n long, n_late long, batch int").parquet(f"{self.root}/marks")

    def daily(self) -> DataFrame:
        """Day, ``by`` and measures over all rows, ``n_late`` of which are corrections by late rows."""
        last = self.marks().agg(F.max("batch").alias("b")).first()["b"]
        return self._merged(last)

    def sliding(self, days: int = 7) -> DataFrame:
        """Measures over windows of ``days`` that move by one day, corrections included: ``first_day`` and ``by``."""
        cells = self.daily().where("day IS NOT NULL").withColumn("first_day", F.explode(F.sequence(F.date_sub("day", days - 1), F.col("day"))))
        return cells.groupBy("first_day", *self.by).agg(*[F.sum(m).alias(m) for m in (*self.measures, "n_late")])

    # --- one batch

    def take(self, df: DataFrame, batch: int) -> None:
        """Write one micro-batch; the function for ``foreachBatch``."""
        at = F.unix_micros(F.col(self.event_time).cast("timestamp"))
        high = self.marks().where(F.col("batch") < batch).agg(F.max("high_us").alias("h")).first()["h"] if batch else None
        mark = None if high is None else high - int(self.delay_days * DAY)
        behind = F.lit(None).cast("long") if mark is None else F.greatest(F.lit(mark) - at, F.lit(0).cast("long"))
        fresh = self._without_repeats(df, batch, at) if self.keys else df
        marked = fresh.withColumn("behind_us", F.when(at.isNotNull(), F.coalesce(behind, F.lit(0).cast("long")))) \
            .withColumn("late", F.coalesce(F.col("behind_us") > 0, F.lit(True))).withColumn("day", F.to_date(self.event_time))
        marked.write.mode("overwrite").partitionBy("late", "day").parquet(f"{self.root}/rows/batch={batch}")
        mine = self.rows().where(F.col("batch") == batch)
        late = F.count_if("late").alias("n_late")
        self._write(mine.groupBy("day", *self.by).agg(*[m().alias(name) for name, m in self.measures.items()], late), "daily", batch)
        if (batch + 1) % self.compact == 0:
            self._write(self._merged(batch), "base", batch)
        # the mark comes last: a batch without one is not finished
        self._write(mine.agg(F.max(at).alias("high_us"), F.count("*").alias("n"), late), "marks", batch)

    def run(self, stream: DataFrame) -> None:
        """Take all that is available; the next call goes on from the checkpoint."""
        query = stream.writeStream.option("checkpointLocation", f"{self.root}/checkpoint").foreachBatch(self.take).trigger(availableNow=True).start()
        query.awaitTermination()

    def _write(self, df: DataFrame, table: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/batch={batch}")

    def _without_repeats(self, df: DataFrame, batch: int, at: Column) -> DataFrame:
        everything = F.struct(*df.columns)
        first = df.where(F.col(self.event_time).isNotNull()).groupBy(*[F.col(k).alias(f"_{k}") for k in self.keys]) \
            .agg(F.min_by(everything, F.struct(at, F.xxhash64(*df.columns))).alias("_r")).select("_r.*")
        first = first.unionByName(df.where(F.col(self.event_time).isNull()))
        if not batch:
            return first
        reach = int(self.delay_days * DAY)
        span = df.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()
        if span["lo"] is None:
            return first
        near = self.rows(before=batch).where(F.col("day").between(F.to_date(F.timestamp_micros(F.lit(span["lo"] - reach))), F.to_date(F.timestamp_micros(F.lit(span["hi"] + reach)))))
        known = near.select(*[F.col(k).alias(f"_{k}") for k in self.keys], F.unix_micros(F.col(self.event_time).cast("timestamp")).alias("_at"))
        same = F.abs(at - F.col("_at")) <= reach
        for k in self.keys:
            same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
        return first.join(known, same, "left_anti")

    def _merged(self, last: int) -> DataFrame:
        """Partial results up to batch ``last``: the latest base and what came after it."""
        held = (last + 1) // self.compact * self.compact - 1
        names = [*self.measures, "n_late"]
        if last == held and (last + 1) % self.compact == 0:
            held -= self.compact  # the base that this call makes
        path = f"{self.root}/daily"
        schema = self.spark.read.parquet(f"{path}/batch={last}").schema
        parts = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])).parquet(path) \
            .where((F.col("batch") > held) & (F.col("batch") <= last)).drop("batch")
        if held >= 0:
            parts = parts.unionByName(self.spark.read.schema(schema).parquet(f"{self.root}/base/batch={held}"))
        return parts.groupBy("day", *self.by).agg(*[F.sum(n).alias(n) for n in names])


def lateness(behind_us: str = "behind_us") -> Column:
    """How far below the mark a late row came: same_day, week, month or older; without an event time: no_time."""
    days = F.col(behind_us) / DAY
    return F.when(days.isNull(), "no_time").when(days <= 0, "on_time").when(days < 1, "same_day").when(days < 7, "week").when(days < 30, "month").otherwise("older")
