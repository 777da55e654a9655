"""Latest values, top-n, pages, dashboard cards and series reads over gold metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _between(gold: DataFrame, as_of: str, days: int) -> DataFrame:
    end = F.lit(as_of).cast("date")
    return gold.where((F.col("metric_date") >= F.date_sub(end, days)) & (F.col("metric_date") <= end)
                      & F.col("metric_value").isNotNull())


def latest_by_metric(gold: DataFrame, as_of: str, days: int = 7, by: tuple[str, ...] = ()) -> DataFrame:
    return _between(gold, as_of, days).groupBy(*by, "metric_name").agg(
        F.max_by("metric_value", "metric_date").alias("metric_value"), F.max("metric_date").alias("metric_date"))


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Bounded top-n: every task keeps n rows, the driver side merges n per task."""
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page (1-based) of a sorted listing, with the total row count."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("total", total.scalar())


def metric_cards(gold: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Current and previous value (last non-zero if zero), change, trend and the last ten values."""
    g = _between(gold, as_of, days).groupBy("metric_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("metric_date", "metric_value"))), lambda x: x["metric_value"]).alias("v"))
    n = F.size("v")

    def last_non_zero(values: Column) -> Column:
        return F.try_element_at(F.filter(values, lambda x: x != 0), F.lit(-1))
    current = F.coalesce(last_non_zero(F.col("v")), F.lit(0.0))
    head = F.slice("v", 1, F.greatest(n - 1, F.lit(0)))
    previous = F.coalesce(last_non_zero(head), F.col("current_value"))
    cards = g.withColumn("current_value", current).withColumn("previous_value", previous)
    change = F.coalesce(F.try_divide((F.col("current_value") - F.col("previous_value")) * 100.0, F.col("previous_value")), F.lit(0.0))
    return cards.withColumn("change_percent", change).select(
        "metric_name", "current_value", "previous_value", "change_percent",
        F.when(F.col("change_percent") > 1, "up").when(F.col("change_percent") < -1, "down").otherwise("stable").alias("trend"),
        F.slice("v", F.greatest(n - 9, F.lit(1)), 10).alias("sparkline"))


def dedup_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order`` (ascending): an aggregate, so a hot key is reduced before the shuffle."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    return df.groupBy(*named).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("_r")).select("_r.*")


def timeseries(gold: DataFrame, name: str, as_of: str, days: int) -> DataFrame:
    return _between(gold, as_of, days).where(F.col("metric_name") == name).select("metric_date", "metric_value").orderBy("metric_date")


def in_set(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other, on, "left_semi")


def not_in_set(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other, on, "left_anti")
