"""What several training-data operators share: written tables, bounded Arrow batches, word counts, seeded orders, prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwise.session import table_path

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: cuts the lineage and outlives lost executors."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Python tasks get at most ``rows`` rows at a time, so that long texts do not fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % n


def seeded(seed: int, *keys: Column) -> Column:
    """A reproducible uniform number in [0, 1) for each row, from its keys alone: 48 bits of the MD5 of seed and keys."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def running_within(df: DataFrame, group: str, value: Column, order: Column, ties: list[str], out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the earlier rows of the same ``group``.

    Rows are ordered by ``order``, a uniform number in [0, 1), then by
    ``ties``. A group of n rows is cut into about sqrt(n) slices of that order;
    each slice is summed on its own and shifted by the totals of the earlier
    slices, so a group that holds a third of the table is no single task.
    Null is a group like any other. ``df`` should be a stored table: it is read
    three times.
    """
    slices = stored(df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
                    .select("_g", F.ceil(F.sqrt(F.col("_n").cast("double"))).alias("_slices")), "slices")
    cut = df.withColumn("_u", order).withColumn("_v", value) \
        .join(slices, F.col(group).eqNullSafe(F.col("_g"))).drop("_g") \
        .withColumn("_slice", F.floor(F.col("_u") * F.col("_slices"))).drop("_slices")
    totals = cut.groupBy(F.col(group).alias("_g"), F.col("_slice").alias("_s")).agg(F.sum("_v").alias("_t"))
    before = W.partitionBy("_g").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    offsets = stored(totals.select("_g", "_s", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_offset")), "offsets")
    inner = W.partitionBy(group, "_slice").orderBy("_u", *ties).rowsBetween(W.unboundedPreceding, -1)
    placed = cut.withColumn("_inner", F.coalesce(F.sum("_v").over(inner), F.lit(0)))
    joined = placed.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_slice") == F.col("_s")))
    return joined.select(*df.columns, (F.col("_inner") + F.col("_offset")).cast("long").alias(out))
