"""Text classifiers on blocks of terms: the models of ``pyspark.ml``, with no number per term outside the blocks."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest
from pyspark.ml.feature import IDF, CountVectorizer, NGram, VectorAssembler
from pyspark.sql import functions as F

from panelwise.operators import learning, linear, terms
from panelwise.session import cut_lineage


def texts(spark, classes, n=240):
    """Texts of a Zipf-like vocabulary that leans towards their class."""
    rng = np.random.default_rng(classes)
    rows = []
    for i in range(n):
        words = (60 * rng.uniform(size=rng.integers(0, 25)) ** 2.5 + 7 * (i % classes) * (rng.uniform() < 0.6)).astype(int)
        rows.append((i, float(i % classes if i % 5 else 0), " ".join(f"w{w}x" for w in words)))
    return cut_lineage(spark.createDataFrame(rows, "id long, label double, text string"))


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(terms, "BLOCK_CHARS", 5_000)
    monkeypatch.setattr(terms, "SLICE_WORDS", 400)
    monkeypatch.setattr(terms, "PIECE", 50)
    monkeypatch.setattr(terms, "SENT", 1000)


def plain(train, test):
    """The models over gathered dictionaries."""
    parts = [NGram(n=2, inputCol="_k", outputCol="_b"), CountVectorizer(inputCol="_k", outputCol="_c1", minDF=3), CountVectorizer(inputCol="_b", outputCol="_c2", minDF=3),
             VectorAssembler(inputCols=["_c1", "_c2"], outputCol="_c"), IDF(inputCol="_c", outputCol="features")]
    model = Pipeline(stages=parts).fit(learning.text_tokens(train))
    x, y = (model.transform(learning.text_tokens(df)) for df in (train, test))
    return {kind: m.fit(x).transform(y) for kind, m in (
        ("logistic", LogisticRegression(maxIter=20, regParam=0.01)), ("bayes", NaiveBayes()), ("svm", OneVsRest(classifier=LinearSVC(maxIter=15))))}


@pytest.mark.parametrize("classes", [2, 3])
def test_the_models_are_those_of_pyspark(spark, small_blocks, classes):
    docs = texts(spark, classes)
    train, test = docs.where("id % 7 > 1"), docs.where("id % 7 < 2")
    got, want = learning.text_predictions(train, test), plain(train, test)
    rows = {kind: [tuple(r) for r in p.select("label", "prediction").collect()] for kind, p in got.items()}
    assert list(rows) == ["logistic", "bayes", "forest", "svm"]
    assert all([a for a, _ in found] == [r[0] for r in test.select("label").collect()] for found in rows.values())
    for kind, p in want.items():
        expected = [tuple(r) for r in p.select("label", "prediction").collect()]
        # a gradient that cancels is rounded either way there, and support vectors follow its sign
        assert sum(a == b for a, b in zip(rows[kind], expected)) >= len(expected) * (0.9 if kind == "svm" else 1), kind


def test_nothing_of_the_size_of_the_vocabulary_is_gathered(spark, small_blocks, monkeypatch):
    docs = spark.range(60).select((F.col("id") % 2).cast("double").alias("label"), F.concat_ws(
        " ", F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: F.concat(F.lit("t"), F.pmod(F.xxhash64("id", i), F.lit(6000)), F.lit("u")))).alias("text"))
    shapes, tables, sums = [], [], terms.TermTable.sums

    def watched(self, give, asked, *rest):
        tables.append(self)
        shapes.extend(asked)
        return sums(self, give, asked, *rest)
    monkeypatch.setattr(terms.TermTable, "sums", watched)
    got = learning.text_predictions(docs, docs, ("logistic", "bayes", "svm"), min_df=1)
    assert all(p.count() == 60 for p in got.values())
    assert tables[0].terms > 10_000 and tables[0].blocks.count() > 5
    assert max(int(np.prod(s)) for s in shapes) <= 60 * 8


def test_texts_without_common_bigrams(spark):
    docs = spark.range(40).select((F.col("id") % 2).cast("double").alias("label"), F.when(F.col("id") % 2 == 0, "bad").otherwise("good").alias("text"))
    for kind, p in learning.text_predictions(docs, docs).items():
        assert p.where("label = prediction").count() == 40, kind


def test_the_steps_of_support_vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 30))
    y = (x[:, 0] + x[:, 1] > 0.3).astype(int)
    x = (x - x.mean(0)) / x.std(0, ddof=1)

    def own(rows):
        return x.T @ rows / 80

    def one(rows):
        return np.array([rows.sum() / 80])

    def margins(done, factors, lengths):
        return np.concatenate(linear.trials(one, done, factors, lengths)) + np.stack([x @ v for v in linear.trials(own, done, factors, lengths)], axis=1)
    done, losses = linear.support_vectors(lambda done: linear.inner_products(own, done) + linear.inner_products(one, done), margins, lambda v: v, y, 15)
    found, shift = linear.repeated(own, done)[0], linear.repeated(one, done)[0]
    assert losses[0] == 1.0 and losses == sorted(losses, reverse=True) and losses[-1] < 0.1
    assert np.mean((x @ found + shift > 0) == y) > 0.95
    loss = np.maximum(0.0, 1.0 - (2 * y - 1) * (x @ found + shift)).mean()
    assert abs(loss - losses[-1]) < 1e-12
