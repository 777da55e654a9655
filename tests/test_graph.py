"""Components of awkward graphs, and models against hand computation."""

import random

import numpy as np
from pyspark.sql import functions as F

from panelwise.functions.scalar import lexicon_score, sentiment_summary
from panelwise.operators import graph, learning


def found(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    return {r["node"]: r["component"] for r in graph.connected_components(df, "a", "b").collect()}


def test_shuffled_chain_star_ring_and_copies(spark):
    rng = random.Random(7)
    ids = list(range(0, 6000))
    rng.shuffle(ids)
    chain, star, ring = ids[:3000], ids[3000:3300], ids[3300:3600]
    edges = list(zip(chain, chain[1:])) + [(star[0], x) for x in star[1:]] + list(zip(ring, ring[1:] + ring[:1]))
    edges += edges[:50] + [(b, a) for a, b in edges[:50]] + [(9000, 9000)]
    rng.shuffle(edges)
    got = found(spark, edges)
    for part in (chain, star, ring):
        assert {got[x] for x in part} == {min(part)}
    assert got[9000] == 9000 and len(got) == 3601


def test_sorted_chain_and_null_ends(spark):
    got = found(spark, [(i, i + 1) for i in range(300)] + [(None, 5), (7, None)])
    assert set(got.values()) == {0} and len(got) == 301


def test_no_edges(spark):
    assert found(spark, []) == {}


def test_lagged_score_is_one_regression_without_intercept(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=60)
    y = np.concatenate([[0.0], 0.8 * x[:-1]]) + 0.3 * rng.normal(size=60)
    rows = [(m, f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", float(v)) for m, s in (("x", x), ("y", y)) for i, v in enumerate(s)]
    gold = spark.createDataFrame(rows, "metric_name string, d string, metric_value double").withColumn("metric_date", F.to_date("d"))
    pairs = spark.createDataFrame([("x", "y"), ("y", "x")], "src string, dst string")
    got = {r["src"]: r["score"] for r in learning.granger_like(pairs, gold).collect()}

    def score(a, b):
        own = np.column_stack([b[3 - i:len(b) - i] for i in (1, 2, 3)])
        both = np.column_stack([own] + [a[3 - i:len(a) - i] for i in (1, 2, 3)])
        r0, r1 = (((b[3:] - m @ np.linalg.lstsq(m, b[3:], rcond=None)[0]) ** 2).sum() for m in (own, both))
        f, d = ((r0 - r1) / 3) / (r1 / (len(b) - 9)), len(b) - 9
        draws = np.random.default_rng(0).f(3, d, 400_000)  # the F distribution by simulation
        return (draws < f).mean()

    assert got["x"] > 0.999 and abs(got["y"] - score(y, x)) < 0.005


def test_forest_samples_stay_full_on_larger_tables(spark):
    points = spark.range(20000).select("id", F.array(F.sin("id"), F.cos(F.col("id") * 3)).alias("features"))
    far = spark.createDataFrame([(99999, [40.0, 40.0])], "id long, features array<double>")
    got = learning.isolation_forest(points.unionByName(far), trees=30).orderBy(F.desc("score")).limit(1).first()
    assert got["id"] == 99999 and 0.5 < got["score"] < 1


def test_lexicon_terms_and_buckets(spark):
    rows = [("This is unacceptable, I am angry and furious, my lawyer will escalate, worst and terrible.",), ("thanks, great",), (" ",), (None,)]
    df = lexicon_score(spark.createDataFrame(rows, "text string"), "text")
    got = [(r["matched"], r["score"], r["bucket"]) for r in df.collect()]
    assert got[0] == (["escalat", "angry", "unacceptable", "terrible", "worst", "furious", "lawyer", "escalate"], 64.0, "escalating_frustration")
    assert got[1] == (["neutral:thank", "neutral:thanks", "neutral:great"], 0.0, "low")
    assert got[2] == (["no_text"], 0.0, "low") and got[3] == (["no_text"], 0.0, "low")
    assert sentiment_summary(df).first().asDict() == {"tickets_analyzed": 4, "escalating_frustration_count": 1, "high_risk_count": 1, "avg_sentiment_score": 16.0}


def test_graph_shrinks_in_every_round(spark):
    rng = random.Random(3)
    ids = list(range(2000))
    rng.shuffle(ids)
    near = spark.createDataFrame([(min(e), max(e)) for e in zip(ids, ids[1:])], "u long, v long").localCheckpoint()
    left = graph._renamed(near, graph._moves(near, 0))
    assert 0 < left.count() < 1200 and left.where("u >= v").isEmpty()


def test_text_ids_loops_and_copies(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "b"), ("b", "b"), ("z", "z"), ("z", "z"), (None, "q"), ("y", "x")], "a string, b string")
    got = sorted((r["node"], r["component"]) for r in graph.connected_components(df, "a", "b").collect())
    assert got == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("z", "z")]
