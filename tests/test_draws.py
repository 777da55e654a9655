"""Reproducible draws: distributions, independence of partitioning, and the ROC band against a plain bootstrap."""

import math

import numpy as np
from pyspark.sql import functions as F

from panelwise.functions.draws import digest, normals, poisson, uniform
from panelwise.operators import evaluation


def test_uniform_and_normal_moments(spark):
    h = digest(F.lit(1), F.col("id"))
    z = normals(h)
    row = spark.range(20000).select(uniform(h, 0).alias("u"), *[x.alias(f"z{i}") for i, x in enumerate(z)]).agg(
        F.avg("u"), F.min("u"), F.max("u"), *[f(f"z{i}") for i in range(4) for f in (F.avg, F.stddev)], F.corr("z0", "z1"), F.corr("z0", "z2")).first()
    assert abs(row[0] - 0.5) < 0.01 and 0 < row[1] and row[2] < 1
    assert all(abs(row[3 + 2 * i]) < 0.03 and abs(row[4 + 2 * i] - 1) < 0.03 for i in range(4))
    assert abs(row[11]) < 0.03 and abs(row[12]) < 0.03


def test_poisson_moments_small_large_and_zero(spark):
    counts = spark.createDataFrame([(0,), (1,), (7,), (64,), (65,), (5000,)], "n long")
    df = counts.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(8000))))
    got = {r["n"]: r for r in poisson(df, "n", digest(F.col("n"), F.col("draw")), "w").groupBy("n").agg(F.avg("w").alias("m"), F.variance("w").alias("v"), F.min("w").alias("low")).collect()}
    assert got[0]["m"] == 0 and got[0]["v"] == 0
    for n in (1, 7, 64, 65, 5000):
        assert abs(got[n]["m"] - n) < 4 * math.sqrt(n / 8000) and abs(got[n]["v"] / n - 1) < 0.1 and got[n]["low"] >= 0


def test_roc_band_does_not_depend_on_partitions_and_holds_the_curve(spark):
    rng = np.random.default_rng(5)
    rows = [(round(float(s), 3), int(y)) for y in (0, 1) for s in rng.normal(0.8 * y, 1, 1500)]
    df = spark.createDataFrame(rows, "score double, label int")
    band = {r["fpr_grid"]: r for r in evaluation.roc_band(df.repartition(3), draws=100, grid=20).collect()}
    again = {r["fpr_grid"]: r for r in evaluation.roc_band(df.repartition(7, "score"), draws=100, grid=20, ranges=3).collect()}
    assert len(band) == 21 and all(abs(band[g][c] - again[g][c]) < 1e-12 for g in band for c in ("mean_tpr", "low", "high"))
    scores, labels = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for g in (2, 10, 18):
        cut = np.quantile(scores[labels == 0], 1 - g / 20)
        true = (scores[labels == 1] > cut).mean()
        assert band[g]["low"] - 0.01 <= true <= band[g]["high"] + 0.01
        spread = math.sqrt(true * (1 - true) / 1500)
        assert band[g]["high"] - band[g]["low"] < 12 * spread


def test_roc_band_of_one_class_and_of_nothing(spark):
    df = spark.createDataFrame([(0.5, 1), (0.7, 1)], "score double, label int")
    assert {r["mean_tpr"] for r in evaluation.roc_band(df, draws=5, grid=4).collect()} == {0.0}
    assert evaluation.roc_band(df.where("false"), draws=5, grid=4).count() == 5
