"""Stored models: the fitted pipeline with its features, defaults and threshold, saved, loaded and applied to batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.operators.learning import score

#: What a missing customer feature counts as (names of ``features.rfm_features``).
RFM_DEFAULTS = {
    "recency_days": 30.0, "frequency": 3.0, "monetary": 500.0, "log_monetary": 6.2, "recency_squared": 900.0, "recency_frequency": 90.0,
    "mean_order": 167.0, "lifespan_days": 60.0, "purchase_rate": 0.05, "mean_review": 4.0, "delivery_days": 12.0, "late_orders": 0.0,
    "late_rate": 0.0, "mean_installments": 2.0, "diversity": 2.0, "items": 5.0, "complaints": 0.0,
}
#: Contract features that order histories cannot tell (names of ``features.TELCO``); all others are 0.
TELCO_DEFAULTS = {"pay_credit_card": 1, "phone_code": 1, "internet_none": 1}


@dataclass(frozen=True)
class StoredModel:
    pipeline: PipelineModel
    features: list[str]
    threshold: float = 0.5
    defaults: dict[str, float] | None = None
    name: str = "model"
    version: str = "1.0"


def save_model(spark: SparkSession, model: StoredModel, folder: str) -> None:
    """Write pipeline and settings below ``folder`` (any file system Spark can write to)."""
    model.pipeline.write().overwrite().save(f"{folder}/pipeline")
    rows = [(i, f, float((model.defaults or {}).get(f, 0.0)), float(model.threshold), model.name, model.version) for i, f in enumerate(model.features)]
    spark.createDataFrame(rows, "place int, feature string, value double, threshold double, name string, version string") \
        .coalesce(1).write.mode("overwrite").parquet(f"{folder}/settings")


def load_model(spark: SparkSession, folder: str) -> StoredModel:
    rows = sorted(spark.read.parquet(f"{folder}/settings").collect(), key=lambda r: r["place"])
    return StoredModel(PipelineModel.load(f"{folder}/pipeline"), [r["feature"] for r in rows], rows[0]["threshold"],
                       {r["feature"]: r["value"] for r in rows}, rows[0]["name"], rows[0]["version"])


def score_batch(df: DataFrame, model: StoredModel, mapping: dict[str, Column] | None = None) -> DataFrame:
    """Add score and prediction to every row.

    ``mapping`` gives a feature from other columns (see :func:`rfm_as_telco`);
    a feature that is neither mapped nor a column, and every null, counts as
    its default.
    """
    defaults = model.defaults or {}
    known = {f: (mapping or {}).get(f, F.col(f) if f in df.columns else F.lit(None)) for f in model.features}
    filled = df.withColumns({f"_in_{f}": F.coalesce(c.cast("double"), F.lit(float(defaults.get(f, 0.0)))) for f, c in known.items()})
    inner = filled.select(F.struct(*df.columns).alias("_row"), *[F.col(f"_in_{f}").alias(f) for f in model.features])
    done = score(inner, model.pipeline, {}, model.threshold)
    return done.select("_row.*", "score", "prediction")


def rfm_as_telco() -> dict[str, Column]:
    """Contract features from order histories, as far as those can tell them."""
    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("double"), F.lit(RFM_DEFAULTS[c]))

    months = F.floor(F.greatest(known("lifespan_days"), F.lit(0.0)) / 30)
    money = known("monetary")
    average = F.coalesce(F.col("mean_order").cast("double"), money / F.greatest(known("frequency"), F.lit(1.0)))
    fixed = {name: F.lit(value) for name, value in TELCO_DEFAULTS.items()}
    return fixed | {"tenure": months, "monthly_charges": average, "total_charges": money, "charges_per_tenure": average / (months + 1),
                    "charges_ratio": money / (months * average + 1), "tenure_band": F.least(F.lit(3), F.floor(months / 12)), "high_value": (average > 100).cast("int")}
