"""Total orders without a single-task window.

Running sums, ranks and exact quantiles over a whole column are computed on
value ranges: distinct values are aggregated first (a hot value becomes one
row) and written, their number says how many ranges there are, Spark's range
partitioning deals them out, and each range is ranked on its own with the
totals of the lower ranges added. Results are exact; the ranges only decide how
the work is split. Nulls sort below all values, NaN above.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwise.session import cut_lineage, written

#: Rows that one task sorts.
RANGE_ROWS = 250_000
#: Ranges of a dictionary whose size is not asked for.
RANGES = 64


def parts_for(rows: int, each: int = RANGE_ROWS) -> int:
    """Number of parts so that one holds about ``each`` rows."""
    return max(1, -(-rows // each))


def with_range(df: DataFrame, value: str, out: str = "_range", ranges: int | None = None, rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` as a written table with the number of the value range of each row (ascending).

    There is one range per ``rows`` rows unless ``ranges`` says how many. The
    table fixes which range a row is in. Equal values share a range.
    """
    table = written(df, "values")
    n = ranges or parts_for(table.count(), rows)
    if n < 2:
        return table.withColumn(out, F.lit(0))
    return written(table.repartitionByRange(n, value).withColumn(out, F.spark_partition_id()), "value-ranges")


def range_offsets(sizes: DataFrame, sums: list[str], ascending: bool = True, nest: int = RANGE_ROWS) -> DataFrame:
    """(_range, _o_<name>, all_<name>): totals of the ranges before each one and of all, from ``_t_<name>`` per range.

    Ranges are in blocks of ``nest``; a block is summed on its own and shifted by the blocks before it, so no task
    holds more than ``nest`` ranges, or one row per block.
    """
    def earlier(window, column: str):
        return window.orderBy(F.col(column).asc() if ascending else F.col(column).desc()).rowsBetween(W.unboundedPreceding, -1)
    whole, inner = W.partitionBy(), W.partitionBy("_block")
    placed = sizes.withColumn("_block", F.floor(F.col("_range") / nest))
    blocks = placed.groupBy("_block").agg(*[F.sum(f"_t_{c}").alias(f"_b_{c}") for c in sums]).select(
        "_block", *[F.coalesce(F.sum(f"_b_{c}").over(earlier(whole, "_block")), F.lit(0)).alias(f"_s_{c}") for c in sums],
        *[F.sum(f"_b_{c}").over(whole).alias(f"all_{c}") for c in sums])
    return placed.join(blocks, "_block").select(
        "_range", *[(F.coalesce(F.sum(f"_t_{c}").over(earlier(inner, "_range")), F.lit(0)) + F.col(f"_s_{c}")).alias(f"_o_{c}") for c in sums],
        *[f"all_{c}" for c in sums])


def running_totals(df: DataFrame, value: str, sums: list[str], ascending: bool = True,
                   ranges: int | None = None, rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``cum_<name>`` (through this value) and ``all_<name>`` for each summed column.

    ``df`` must hold one row per distinct ``value``.
    """
    spread = with_range(df, value, ranges=ranges, rows=rows)
    totals = spread.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    inner = W.partitionBy("_range").orderBy(F.col(value).asc() if ascending else F.col(value).desc()) \
        .rowsBetween(W.unboundedPreceding, 0)
    return spread.join(range_offsets(totals, sums, ascending), "_range").select(
        *df.columns, *[(F.sum(c).over(inner) + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in sums],
        *[f"all_{c}" for c in sums])


def exact_quantiles(df: DataFrame, value: str, probs: list[float], ranges: int | None = None) -> DataFrame:
    """Linearly interpolated quantiles, one row (prob, quantile) per requested probability."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")) \
        .agg(F.count("*").alias("n"))
    ranked = running_totals(counts, "v", ["n"], ranges=ranges)
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    # every value answers for the positions its copies occupy; two positions are needed per probability
    placed = ranked.select("v", "n", "cum_n", "all_n", wanted) \
        .withColumn("_pos", F.col("prob") * (F.col("all_n") - 1)) \
        .withColumn("_lo", F.floor("_pos")).withColumn("_hi", F.ceil("_pos"))
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    return placed.where(((first <= F.col("_lo")) & (F.col("_lo") <= last)) | ((first <= F.col("_hi")) & (F.col("_hi") <= last))) \
        .groupBy("prob").agg(
            (F.min("v") + (F.max("v") - F.min("v")) * F.first(F.col("_pos") - F.col("_lo"))).alias("quantile"))


def dense_index(values: DataFrame, column: str, out: str, ranges: int | None = RANGES) -> DataFrame:
    """0-based position of every distinct value of a column in sorted order.

    The dictionary is range-partitioned once and materialised, so the range a
    value fell into is fixed; each range is numbered on its own and shifted by
    the sizes of the lower ranges (one row per range). Where ``ranges`` is None,
    their number follows from that of the values.
    """
    distinct = values.where(F.col(column).isNotNull()).select(column).distinct()
    if ranges is None:
        placed = with_range(distinct, column)
        offsets = range_offsets(placed.groupBy("_range").agg(F.count("*").alias("_t_n")), ["n"])
        inside = F.row_number().over(W.partitionBy("_range").orderBy(column)) - 1
        return placed.join(offsets, "_range").select(column, (inside + F.col("_o_n")).alias(out))
    placed = cut_lineage(distinct.repartitionByRange(ranges, column).withColumn("_p", F.spark_partition_id()))
    before = W.partitionBy().orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("_p").agg(F.count("*").alias("_n")) \
        .select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    w = W.partitionBy("_p").orderBy(column)
    return placed.join(F.broadcast(offsets), "_p").select(column, (F.row_number().over(w) - 1 + F.col("_o")).alias(out))


def pseudo_labels(scores: DataFrame, score: str, contamination: float) -> DataFrame:
    """True where the score reaches the (1 - contamination) quantile."""
    cut = exact_quantiles(scores, score, [1.0 - contamination]).select("quantile")
    return scores.withColumn("label", F.col(score) >= cut.scalar())


def attach_scalar(df: DataFrame, value: DataFrame, name: str) -> DataFrame:
    """Add the single value of a one-row, one-column frame as a constant column."""
    return df.withColumn(name, value.scalar())

