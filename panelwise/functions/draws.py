"""Reproducible random numbers from the MD5 of a key: the same on every engine, however the rows are partitioned."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Counts up to this get exact Poisson draws, larger ones the quantile expansion.
EXACT_POISSON = 64
#: Draws beyond this have a probability below 1e-12 for every exact count.
MOST_DRAWN = 150


def digest(*keys: Column) -> Column:
    """MD5 of the keys joined by colons: 32 hex digits, four uniforms."""
    return F.md5(F.concat_ws(":", *[k.cast("string") for k in keys]).cast("binary"))


def uniform(md5: Column, part: int) -> Column:
    """Uniform in (0, 1) from 8 hex digits; ``part`` is 0 to 3."""
    return (F.conv(F.substring(md5, 8 * part + 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def normals(md5: Column) -> list[Column]:
    """Four standard normals of one digest (Box and Muller)."""
    out = []
    for a, b in ((0, 1), (2, 3)):
        length, turn = F.sqrt(-2.0 * F.log(uniform(md5, a))), 2.0 * math.pi * uniform(md5, b)
        out += [length * F.cos(turn), length * F.sin(turn)]
    return out


def poisson_table(spark: SparkSession) -> DataFrame:
    """(n, draw, low, high): the interval of a uniform that gives a Poisson(n) draw, for n up to ``EXACT_POISSON``; a fixed small size."""
    cells = spark.range(1, EXACT_POISSON + 1).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(MOST_DRAWN))).alias("draw"))
    up = W.partitionBy("n").orderBy("draw")
    log_factorial = F.sum(F.when(F.col("draw") > 0, F.log(F.col("draw").cast("double"))).otherwise(0.0)).over(up)
    term = F.exp(F.col("draw") * F.log(F.col("n").cast("double")) - F.col("n") - F.col("_lf"))
    return cells.withColumn("_lf", log_factorial).withColumn("high", F.sum(term).over(up)) \
        .select("n", "draw", F.coalesce(F.lag("high").over(up), F.lit(0.0)).alias("low"),
                F.when(F.col("draw") == MOST_DRAWN, F.lit(2.0)).otherwise(F.col("high")).alias("high"))


def poisson(df: DataFrame, n: str, md5: Column, out: str) -> DataFrame:
    """Add ``out``, a Poisson(n) draw: what n rows drawn with replacement, each Poisson(1) times, add up to. 0 for n = 0.

    Exact up to ``EXACT_POISSON`` by the inverse distribution; larger counts
    use the expansion of their quantiles to the second order in 1 / sqrt(n).
    """
    table = F.broadcast(poisson_table(df.sparkSession).select(F.col("n").alias("_n"), F.col("draw").alias("_draw"), F.col("low").alias("_low"), F.col("high").alias("_high")))
    z = normals(F.col("_md5"))[2]
    large = F.greatest(F.lit(0.0), F.floor(F.col(n) + F.sqrt(F.col(n).cast("double")) * z + (z * z - 1) / 6 + 0.5)).cast("long")
    marked = df.withColumn("_md5", md5).withColumn("_u", uniform(F.col("_md5"), 0))
    return marked.join(table, (F.col(n) == F.col("_n")) & (F.col("_u") >= F.col("_low")) & (F.col("_u") < F.col("_high")), "left") \
        .withColumn(out, F.when(F.col(n) > EXACT_POISSON, large).otherwise(F.coalesce("_draw", F.lit(0))).cast("long")).select(*df.columns, out)
