"""Permutation index: queries the pivots say little about are complete and exact."""

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("panelwise.llm")

from panelwise.llm import permutation  # noqa: E402


def brute(ids, vectors, i, k=10):
    apart = np.sqrt(((vectors - vectors[i]) ** 2).sum(1))
    order = [j for j in np.lexsort((ids, apart)) if j != i][:k]
    return [int(ids[j]) for j in order]


@pytest.mark.parametrize("kind", ["shifted", "scaled", "clustered", "equal_order"])
def test_every_query_is_complete_with_recall(spark, kind):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(600, 64))
    if kind == "clustered":
        vectors = rng.normal(size=(12, 64))[rng.integers(0, 12, 600)] * 5 + 0.05 * vectors
    asked = list(range(0, 600, 40))
    for i in asked:
        if kind == "shifted":
            vectors[i] += 6
        if kind == "scaled":
            vectors[i] *= 4
        if kind == "equal_order":
            vectors[i] = vectors[i] * 1e-3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = permutation.nearest(df, df.where(F.col("vec_id").isin(asked)), k=10).collect()
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    ids, right = np.arange(600), 0
    for i in asked:
        assert sorted(found[i]) == list(range(1, 11)), (kind, i)
        right += len(set(found[i].values()) & set(brute(ids, vectors, i)))
    assert right >= 0.9 * 10 * len(asked), (kind, right)


def test_fewer_candidates_than_k_are_all_returned(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(4)], "vec_id long, embedding array<double>")
    rows = permutation.nearest(df, df.where("vec_id = 0"), k=10).collect()
    assert [r["vec_id"] for r in sorted(rows, key=lambda r: r["rank"])] == [1, 2, 3]
