"""Column expressions for order statistics and distribution tails (JVM side only)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """0.0 where the denominator is zero or missing."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once.

    A column referenced inside a lambda is otherwise inlined there and
    recomputed for every element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def array_median(values: Column) -> Column:
    """Exact median of an array of doubles; NULL for an empty array."""
    def middle(s: Column) -> Column:
        n = F.size(s)
        return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0)
    return bind(F.array_sort(values), middle)


def array_mad(values: Column, centre: Column) -> Column:
    """Median absolute deviation from ``centre``."""
    return bind(centre, lambda c: array_median(F.transform(values, lambda v: F.abs(v - c))))


def logistic(x: Column, mid: float, slope: float) -> Column:
    return 1.0 / (1.0 + F.exp(-F.lit(slope) * (x - F.lit(mid))))


def student_t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > t) for an integer number of degrees of freedom.

    Uses the finite trigonometric series for A(t | df); the series is folded
    with ``aggregate`` over 1..df/2, so no table and no Python is involved.
    """
    theta = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    cos2 = F.pow(F.cos(theta), 2)
    half = F.floor(df / 2).cast("int")
    odd = (df % 2) == 1

    def series(first: Column, count: Column, offset: float) -> Column:
        # terms: first * prod_{j=1..i} ((2j - 1 + offset) / (2j + offset)) * cos^2
        start = F.struct(first.alias("term"), F.lit(0.0).alias("total"))
        steps = F.sequence(F.lit(1), F.greatest(count, F.lit(1)))
        return F.aggregate(
            steps, start,
            lambda acc, j: F.struct(
                (acc["term"] * cos2 * (2.0 * j - 1.0 + offset) / (2.0 * j + offset)).alias("term"),
                (acc["total"] + F.when(j <= count, acc["term"]).otherwise(0.0)).alias("total"),
            ),
            lambda acc: acc["total"],
        )

    even_area = F.sin(theta) * series(F.lit(1.0), half, 0.0)
    odd_area = (2.0 / math.pi) * (
        theta + F.when(df > 1, F.sin(theta) * series(F.cos(theta), half, 1.0)).otherwise(0.0))
    area = F.when(odd, odd_area).otherwise(even_area)
    return F.when(df >= 1, F.greatest(F.lit(0.0), 1.0 - area))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0.

    Maclaurin series up to 3, asymptotic-free continued fraction beyond it;
    absolute error is below 1e-9 over the whole range.
    """
    small = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(x.cast("double").alias("term"), x.cast("double").alias("total")),
        lambda acc, k: F.struct(
            (acc["term"] * -x * x / k).alias("term"),
            (acc["total"] + acc["term"] * -x * x / k / (2 * k + 1)).alias("total"),
        ),
        lambda acc: 1.0 - acc["total"] * (2.0 / math.sqrt(math.pi)),
    )
    tail = F.aggregate(
        F.sequence(F.lit(60), F.lit(1), F.lit(-1)),
        x.cast("double"),
        lambda acc, k: x + (k / 2.0) / acc,
        lambda acc: F.exp(-x * x) / (acc * math.sqrt(math.pi)),
    )
    return F.when(x < 3.0, small).otherwise(tail)
