"""Exact top-k search in binary codes by incremental multi-index hashing.

A code of B bits is cut into m segments; every segment value has a posting
list. If two codes differ in at most m * (r + 1) - 1 bits, one of their
segments differs in at most r bits. So a query probes all segment values at
distance 0, then 1, then 2, ... and stops as soon as its k-th verified
distance is provably covered by the radius searched so far. Only unfinished
queries go on; there is no limit on the radius.

Equal codes are one entry that keeps the ids that can matter (the k + 1
smallest); the row limit per group is applied before the shuffle, so a code
that a third of all rows share is small. Only DataFrame functions run here.

Defined results: rows whose code is null, of another length or holds anything
but 0 and 1 take no part; with fewer candidates than k all are returned; equal
distances go to the smaller id; rows that repeat id and code are one; rows of
one id with different codes are kept apart and are never each other's
neighbours; an empty table gives no rows; other columns do not take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwise.llm.common import stored

SEGMENT_BITS = 16


def sign_bits(vector: Column) -> Column:
    """Binary code of a vector: 1 where a component is above 0; null if a component is null or not finite."""
    proper = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(proper, F.transform(vector, lambda x: (x > 0).cast("int")))


def _segments(bits: Column, length: int, width: int) -> Column:
    """Segments of a code as array<bigint>; the first bit of a segment is its lowest."""
    cuts = range(0, length, width)
    return F.array(*[F.aggregate(F.reverse(F.slice(bits, a + 1, min(width, length - a))), F.lit(0).cast("long"), lambda s, b: s * 2 + b) for a in cuts])


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two codes in segments."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _masks(spark: SparkSession, width: int, radius: int) -> Column:
    """All segment values with ``radius`` bits set, as one array."""
    return spark.range(1 << width).where(F.bit_count("id") == radius).agg(F.collect_list("id")).scalar()


def _first_rows(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def top_k(codes: DataFrame, queries: DataFrame, length: int, k: int = 10, key: str = "id", bits: str = "bits",
          width: int = SEGMENT_BITS) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest codes of every row of ``queries``, exactly.

    Both tables have ``key`` and ``bits`` (array of 0 and 1, ``length`` long);
    a query's own row is no candidate.
    """
    spark = codes.sparkSession

    def coded(df: DataFrame) -> DataFrame:
        good = (F.size(bits) == length) & F.forall(bits, lambda b: b.isin(0, 1)) & F.col(key).isNotNull()
        return df.where(F.coalesce(good, F.lit(False))).select(F.col(key).cast("long").alias("id"), _segments(F.col(bits), length, width).alias("code"))

    rows = stored(coded(codes).distinct(), "codes")
    asked = stored(coded(queries).distinct(), "query-codes")
    total = rows.count()
    segments = -(-length // width)
    entries = stored(_first_rows(rows, "code", ["id"], k + 1).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "code-entries")
    postings = stored(entries.select("code", "ids", F.posexplode("code").alias("segment", "value")), "postings")
    active = asked.select("code").distinct()
    found, done, radius = None, None, 0
    while True:
        probes = None
        for s in range(segments):
            wide = min(width, length - s * width)
            if radius <= wide:
                part = active.withColumn("masks", _masks(spark, wide, radius)).select("code", F.explode("masks").alias("mask")) \
                    .select(F.col("code").alias("query"), F.lit(s).alias("segment"), F.col("code")[s].bitwiseXOR(F.col("mask")).alias("value"))
                probes = part if probes is None else probes.unionByName(part)
        # the size of exploded probes is not in Spark's estimates, which would send them to every task by way of the driver
        new = probes.hint("merge").join(postings, ["segment", "value"]).select("query", "code", "ids").distinct() \
            .select("query", distance(F.col("query"), F.col("code")).alias("distance"), F.explode("ids").alias("id"))
        if found is not None:
            new = new.unionByName(found)
        best = stored(_first_rows(new.distinct(), "query", ["distance", "id"], k + 1), f"nearest-{radius}")
        covered = segments * (radius + 1) - 1
        need = min(k + 1, total)
        ready = best.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("far")).where(
            F.lit(radius >= width) | ((F.col("n") >= need) & (F.col("far") <= covered))).select("query")
        ready = stored(ready, f"finished-{radius}")
        ended = best.join(ready, "query", "left_semi")
        done = ended if done is None else done.unionByName(ended)
        active = stored(active.join(ready, F.col("code") == F.col("query"), "left_anti"), f"open-{radius}")
        if radius >= width or active.isEmpty():
            break
        found = best.join(ready, "query", "left_anti")
        radius += 1
    each = asked.select(F.col("id").alias("query_id"), F.col("code").alias("query")).join(done, "query").where("id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id", "query").orderBy("distance", "id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
