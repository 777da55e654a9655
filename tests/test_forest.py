"""The sparse forest and the text classifiers that share one set of counts."""

from pyspark.sql import functions as F

from panelwise.operators import forest, learning


def test_forest_splits_on_counts_and_absent_terms(spark):
    rows = spark.range(400).select(F.col("id").alias("row"), (F.col("id") % 2).cast("double").alias("label"))
    # class 1 holds "a" twice, class 0 once or, for every fourth row, not at all; the rest is noise of 40 terms
    entries = rows.select("row", F.lit("a").alias("term"), F.when(F.col("label") == 1, 2).otherwise(1).cast("long").alias("n")).where("label = 1 OR row % 4 <> 0") \
        .unionByName(rows.select("row", F.explode(F.array(*[F.concat(F.lit("z"), F.pmod(F.xxhash64("row", F.lit(i)), F.lit(40))) for i in range(3)])).alias("term"),
                                 F.lit(1).cast("long").alias("n")).distinct())
    model = forest.fit_forest(rows, entries, trees=15, depth=4)
    got = model.predict(rows, entries).join(rows, "row")
    assert got.count() == 400
    assert got.where("prediction = label").count() >= 380
    assert model.predict(rows.limit(3), entries.where("false")).count() == 3


def test_forest_of_one_class(spark):
    rows = spark.range(5).select(F.col("id").alias("row"), F.lit(1.0).alias("label"))
    entries = rows.select("row", F.lit("a").alias("term"), F.lit(1).cast("long").alias("n"))
    assert {r.prediction for r in forest.fit_forest(rows, entries, trees=3).predict(rows, entries).collect()} == {1.0}


def test_all_kinds_of_text_models_from_one_tokenisation(spark):
    docs = spark.range(120).select((F.col("id") % 2).cast("double").alias("label"), F.concat_ws(
        " ", F.when(F.col("id") % 2 == 0, "poor broken cheap").otherwise("great lovely solid"), F.concat(F.lit("filler"), F.col("id") % 5)).alias("text"))
    got = learning.text_predictions(docs, docs)
    assert list(got) == ["logistic", "bayes", "forest", "svm"]
    for kind, p in got.items():
        assert p.count() == 120 and p.where("label = prediction").count() >= 115, kind
