"""Saving, loading, defaults and schema mapping of models; the end-to-end jobs."""

from pyspark.sql import functions as F

from panelwise.operators import features, learning, serving


def test_model_round_trip_and_mapping(spark, tmp_path):
    train = spark.range(200).select((F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 2 * 30.0 + F.col("id") % 7).alias("tenure"),
                                    (F.col("id") % 5).cast("double").alias("monthly_charges"))
    names = ["tenure", "monthly_charges"]
    model = serving.StoredModel(learning.fit_binary(train, names), names, 0.3, {"tenure": 30.0}, "churn", "2.0")
    serving.save_model(spark, model, str(tmp_path / "model"))
    back = serving.load_model(spark, str(tmp_path / "model"))
    assert (back.features, back.threshold, back.defaults, back.name, back.version) == (names, 0.3, {"tenure": 30.0, "monthly_charges": 0.0}, "churn", "2.0")
    rows = spark.createDataFrame([(1, 0.0, 2.0), (2, None, 2.0), (3, 30.0, None)], "id long, tenure double, monthly_charges double")
    got = {r["id"]: r for r in serving.score_batch(rows, back).collect()}
    assert got[1]["prediction"] == 0 and got[2]["prediction"] == 1 and got[3]["prediction"] == 1
    assert all(r["prediction"] == int(r["score"] >= 0.3) for r in got.values())
    assert serving.score_batch(rows.select("id"), back).where("prediction = 1").count() == 3


def test_order_history_as_contract_features(spark):
    rfm = spark.createDataFrame([(1, 400.0, 4.0, 800.0, None), (2, None, None, None, 50.0)], "id long, lifespan_days double, frequency double, monetary double, mean_order double")
    m = serving.rfm_as_telco()
    got = {r["id"]: r for r in rfm.select("id", *[c.alias(k) for k, c in m.items()]).collect()}
    assert (got[1]["tenure"], got[1]["monthly_charges"], got[1]["tenure_band"], got[1]["high_value"]) == (13, 200.0, 1, 1)
    assert (got[2]["tenure"], got[2]["monthly_charges"], got[2]["total_charges"], got[2]["high_value"]) == (2, 50.0, 500.0, 0)
    assert set(m) <= set(features.TELCO)
