"""Whitening of embeddings by the covariance of distinct vectors with their multiplicities.

Components are quantised to integers x, equal x vectors become one row with
their count, and mean and covariance are fitted with the counts (or one each)
as weights: every task centres its distinct vectors and adds up one weighted
matrix product. Each distinct vector is whitened once, and the rows get their
result by a join.

The driver gets the sums of each dimension and one covariance matrix: its
size depends on the length of the vectors, not on the table. A vector that more than one
row in ``HEAVY`` has is joined by broadcast (there are fewer than ``HEAVY``
of them), all others by a shuffle in which no key is heavy.

Defined results: vectors that are null, empty, of another length than most, or
hold null or non-finite components take no part; an empty table gives no
rows; a component without variance is whitened to null and not part of the
identity error; null and repeated ids are rows like any other; other columns
do not take part. Components of equal variance are any unit vectors of their
common space, the same for all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import small_batches, stored

#: Quantisation: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: A vector is heavy if more than one row in so many has it.
HEAVY = 256


def quantised(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """The integer vector of an embedding."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(F.lit(float(scale)) * c).cast("long") + F.lit(shift).cast("long"))


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, x) of the rows whose vector takes part."""
    vec = F.col(vector).cast("array<double>")
    good = (F.size(vec) > 0) & F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = df.where(F.coalesce(good, F.lit(False))).select(F.col(key).alias("id"), F.col(vector).alias("_v"))
    sizes = rows.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("_v") == (sizes["n"] if sizes else 0)).select("id", quantised(F.col("_v")).alias("x"))


@dataclass(frozen=True)
class Whitener:
    """Number of fitted vectors, sums per dimension, eigenvalues from the largest on, their unit vectors as columns, trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S is exact in integers; dividing it by n rounds once."""
        return (self.n * x - self.sums) / self.n

    def project(self, x: np.ndarray, parts: int) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.centred(x) @ self.vectors[:, :parts] / np.sqrt(np.where(self.live(parts), self.values[:parts], np.nan))

    def live(self, parts: int) -> np.ndarray:
        """Components whose variance is more than rounding."""
        return self.values[:parts] > max(self.values[0], 0) * len(self.values) * np.finfo(float).eps

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exact."""
        apart = self.n * x - self.sums
        most = int(np.abs(apart).max(initial=0))
        if most * most * apart.shape[1] < 1 << 63:
            return (apart * apart).sum(axis=1).tolist()
        return [sum(v * v for v in row) for row in apart.tolist()]


def _matrix(values: pa.Array, n: int) -> np.ndarray:
    return np.asarray(values.flatten(), dtype=np.int64).reshape(n, -1)


def _summed(df: DataFrame, cells: Column) -> dict[int, float]:
    return {r["pos"]: r["total"] for r in df.select(F.posexplode(cells)).groupBy("pos").agg(F.sum("col").alias("total")).collect()}


def fit(distinct: DataFrame) -> Whitener | None:
    """Fit on (x, weight): a vector counts ``weight`` times. None for an empty table."""
    n = distinct.agg(F.sum("weight").alias("n")).first()["n"]
    if not n:
        return None
    sums = _summed(distinct, F.transform("x", lambda v: v * F.col("weight")))
    d = len(sums)
    total = np.array([sums[i] for i in range(d)], np.int64)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, seen = np.zeros((d, d)), False
        for batch in batches:
            if batch.num_rows:
                # centred first: the squares of x itself would drown the variances
                x = (n * _matrix(batch.column(0), batch.num_rows) - total) / n
                gram += (x * np.asarray(batch.column(1), float)[:, None]).T @ x
                seen = True
        if seen:
            ends = pa.array(np.arange(0, d * d + 1, d), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.ListArray.from_arrays(ends, pa.array(gram.ravel()))], ["i", "row"])

    parts = distinct.select("x", "weight").mapInArrow(products, "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).where("j >= i").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    cov = np.zeros((d, d))
    for r in cells:
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["v"] / n
    values, vectors = np.linalg.eigh(cov)
    return Whitener(int(n), total, values[::-1], vectors[:, ::-1], float(np.trace(cov)))


def identity_error(whitened: DataFrame, live: np.ndarray, n: int) -> float:
    """Largest absolute entry of the covariance of (w, weight), minus the identity, over the live components."""
    k = int(live.sum())
    keep = np.flatnonzero(live).tolist()
    cell = [F.col("w")[i] for i in keep]
    sums = [F.sum(c * F.col("weight")) for c in cell]
    cross = [F.sum(cell[i] * cell[j] * F.col("weight")) for i in range(k) for j in range(i, k)]
    got = list(whitened.agg(*sums, *cross).first()) if k else []
    mean, rest, worst = np.array(got[:k], float) / n, iter(got[k:]), 0.0
    for i in range(k):
        for j in range(i, k):
            worst = max(worst, abs(next(rest) / n - mean[i] * mean[j] - (i == j)))
    return worst


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = 8, weights: str = "counts") -> DataFrame:
    """(key, w array<double>, deviation decimal, n, explained array<double>, identity_error) of every row whose vector takes part.

    ``weights``: "counts" fits on all rows, "one" on each distinct vector once.
    """
    if weights not in ("counts", "one"):
        raise ValueError(f"weights is counts or one, not {weights}")
    spark = df.sparkSession
    small_batches(spark, 4096)
    rows = stored(usable(df, key, vector), "vectors")
    distinct = stored(rows.groupBy("x").agg(F.count("*").alias("_count"))
                      .withColumn("weight", F.col("_count") if weights == "counts" else F.lit(1).cast("long")), "distinct-vectors")
    model = fit(distinct)
    if model is None:
        return rows.select(F.col("id").alias(key), F.array().cast("array<double>").alias("w"), F.lit(0).cast("decimal(38,0)").alias("deviation"),
                           F.lit(0).cast("long").alias("n"), F.array().cast("array<double>").alias("explained"), F.lit(0.0).alias("identity_error"))
    parts = min(parts, len(model.values))
    live = model.live(parts)

    @F.arrow_udf("w array<double>, deviation decimal(38,0)")
    def projected(vectors: pa.Array) -> pa.Array:
        x = _matrix(vectors, len(vectors)) if len(vectors) else np.zeros((0, len(model.sums)), np.int64)
        ends = pa.array(np.arange(0, len(x) * parts + 1, parts), pa.int32())
        flat = pa.array(model.project(x, parts).ravel(), from_pandas=True)  # NaN: no variance
        deviations = pa.array([Decimal(v) for v in model.deviation(x)], pa.decimal128(38, 0))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, flat), deviations], ["w", "deviation"])

    done = stored(distinct.withColumn("_p", projected(F.col("x"))).select("x", "_count", "weight", "_p.*"), "whitened-vectors")
    error = identity_error(done, live, model.n)
    explained = model.values[:parts] / model.trace if model.trace > 0 else np.zeros(parts)
    heavy = rows.count() // HEAVY
    often = F.broadcast(done.where(F.col("_count") > heavy).select("x", "w", "deviation"))  # fewer than HEAVY vectors
    seldom = done.where(F.col("_count") <= heavy).select("x", "w", "deviation")
    light = rows.join(often.select("x"), "x", "left_anti").join(seldom, "x")
    return rows.join(often, "x").unionByName(light).select(
        F.col("id").alias(key), "w", "deviation", F.lit(model.n).cast("long").alias("n"),
        F.array(*[F.lit(float(e)) for e in explained]).alias("explained"), F.lit(float(error)).alias("identity_error"))
