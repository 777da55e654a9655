"""Packing into optimal length buckets: dynamic programming over the global histogram of lengths.

Bucket boundaries are those that waste the fewest padding tokens when every
document is padded to its bucket's boundary. Inside a bucket documents form
batches in a seeded order; a batch holds as many as fit the token budget, at
least one.

Defined results: null lengths count as 0; a document longer than the budget is
a batch of its own; repeated rows are packed as often as they occur; an empty
table gives an empty result; other columns are kept, but for the names this
module adds.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import running_within, seeded, stored

BUCKETS = 8
TOKEN_BUDGET = 32_768


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Boundaries (the last is the largest length) that minimise sum(count * boundary), by dynamic programming.

    For each number of buckets the best start of the last one is the lowest of
    some lines at the length asked for. Slopes fall and lengths rise, so one
    pass over the lower hull finds all of them: linear in the lengths, in exact
    integers.
    """
    sizes, d = [int(n) for n in lengths], len(lengths)
    if d == 0:
        return []
    below = [0]
    for n in counts:
        below.append(below[-1] + int(n))
    cost = [below[i + 1] * sizes[i] for i in range(d)]  # one bucket for the first i lengths
    choices = []
    for _ in range(1, min(buckets, d)):
        # a line (slope, constant, j): buckets so far end at length j, the next one begins after it
        new, choice, hull, at = cost.copy(), [-1] * d, [], 0
        for i in range(1, d):
            m, c = -below[i], cost[i - 1]
            while len(hull) > at + 1 and (c - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                hull.pop()
            hull.append((m, c, i - 1))
            n = sizes[i]
            while at + 1 < len(hull) and hull[at + 1][0] * n + hull[at + 1][1] < hull[at][0] * n + hull[at][1]:
                at += 1
            total = below[i + 1] * n + hull[at][0] * n + hull[at][1]
            if total < new[i]:
                new[i], choice[i] = total, hull[at][2]
        choices.append(choice)
        cost = new
    out, i = [], d - 1
    for choice in reversed(choices):
        out.append(sizes[i])
        i = choice[i]
        if i < 0:
            return out[::-1]
    out.append(sizes[i])
    return out[::-1]


def length_boundaries(df: DataFrame, length: str, buckets: int = BUCKETS) -> list[int]:
    """Optimal boundaries for a table; the driver gets the true histogram of lengths.

    Different lengths add up to no more than all tokens, so a table of t tokens
    has at most sqrt(2 t) + 1 cells: 1.4 million for 10^12 tokens.
    """
    cells = df.groupBy(F.coalesce(F.col(length), F.lit(0)).cast("long").alias("b")).agg(F.count("*").alias("n")).toArrow()
    lengths, counts = cells["b"].to_numpy(), cells["n"].to_numpy()
    order = np.argsort(lengths)
    return best_boundaries(lengths[order], counts[order], buckets)


def pack(df: DataFrame, length: str, key: str = "doc_id", buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, seed: int = 5) -> DataFrame:
    """Add bucket (from 0), bucket_length, batch (from 0 in each bucket), slot (from 0 in each batch) and padding.

    ``df`` should be a stored table. Places in a bucket come from slices of
    the seeded order, so a bucket that holds most documents is no single task.
    """
    edges = length_boundaries(df, length, buckets)
    if not edges:
        return df.select("*", *[F.lit(0).cast(t).alias(c) for c, t in (("bucket", "int"), ("bucket_length", "long"), ("batch", "long"), ("slot", "long"), ("padding", "long"))])
    size = F.coalesce(F.col(length), F.lit(0)).cast("long")
    chosen = F.lit(len(edges) - 1)
    for i in range(len(edges) - 2, -1, -1):
        chosen = F.when(size <= edges[i], F.lit(i)).otherwise(chosen)
    placed = stored(df.withColumn("bucket", chosen.cast("int")), "buckets")
    numbered = running_within(placed, "bucket", F.lit(1), seeded(seed, F.col(key)), [key, length], "_place")
    bound = F.element_at(F.array(*[F.lit(e).cast("long") for e in edges]), F.col("bucket") + 1)
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(bound, F.lit(1)))).cast("long")
    return numbered.withColumn("bucket_length", bound).withColumn("_each", each) \
        .withColumn("batch", F.expr("_place div _each")).withColumn("slot", F.expr("_place % _each")) \
        .withColumn("padding", F.col("bucket_length") - size).drop("_place", "_each")


def bucket_of(edges: list[int], length: int) -> int:
    """Number of the bucket a length falls into."""
    return bisect.bisect_left(edges, length)
