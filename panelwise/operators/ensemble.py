"""The three day-level detectors and their vote: isolation forest, local outlier factor, reconstruction error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.operators import detection, learning, neighbours
from panelwise.operators.ordering import exact_quantiles
from panelwise.session import cut_lineage

FEATURES = ["value", "rolling_mean", "rolling_std", "deviation", "rate_of_change"]


def day_points(wide: DataFrame, metrics: list[str]) -> DataFrame:
    """(id, metric_date, features): one standardised point per panel day."""
    u = detection.univariate_features(wide, metrics).withColumn("id", F.unix_date("metric_date").cast("long"))
    return cut_lineage(neighbours.standardised(u, FEATURES).select("id", "metric_date", "features"))


def detector_flags(points: DataFrame, contamination: float = 0.02) -> DataFrame:
    """(id, detector, flag) of the three detectors for every day."""
    rows = points.select("id", "features")
    forest = learning.isolation_forest(rows, contamination=contamination).select("id", F.lit("isolation_forest").alias("detector"), F.col("is_anomaly").alias("flag"))
    lof = cut_lineage(neighbours.local_outlier_factor(rows))
    cut = exact_quantiles(lof, "lof", [1 - contamination]).select("quantile").scalar()
    local = lof.select("id", F.lit("local_outlier_factor").alias("detector"), (F.col("lof") >= cut).alias("flag"))
    error = learning.reconstruction_error(rows, "id", quantile=1 - contamination).select("id", F.lit("reconstruction").alias("detector"), F.col("is_anomaly").alias("flag"))
    return cut_lineage(forest.unionByName(local).unionByName(error))


def anomalous_days(wide: DataFrame, metrics: list[str], min_votes: int = 2, contamination: float = 0.02) -> DataFrame:
    """(metric_date, votes, detectors, weighted_score, is_anomaly): days that at least ``min_votes`` detectors flag."""
    points = day_points(wide, metrics)
    voted = detection.vote(detector_flags(points, contamination), ["id"], min_votes)
    return points.select("id", "metric_date").join(voted, "id").drop("id")
