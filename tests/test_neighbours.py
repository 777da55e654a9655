"""Exact neighbours by the metric tree against brute force, on shapes that one projection cannot split."""

import numpy as np
import pytest

from panelwise.operators import neighbours


def brute(vectors, weights, i, k):
    apart = np.sqrt(((vectors - vectors[i]) ** 2).sum(1))
    found, left = [], k
    for j in np.lexsort((np.arange(len(vectors)), apart)):
        w = min(weights[j] - (j == i), left)
        if w > 0:
            found.append((round(float(apart[j]), 9), int(j), int(w)))
            left -= w
    return found


def shapes(kind):
    rng = np.random.default_rng(3)
    if kind == "equal_sums":
        x = rng.normal(size=(900, 4))
        x[:, 3] = -x[:, :3].sum(1)  # all on one plane: equal coordinate sums
        return x
    if kind == "clusters":
        return rng.normal(size=(6, 3))[rng.integers(0, 6, 700)] * 20 + 0.01 * rng.normal(size=(700, 3))
    if kind == "grid":
        return np.array([(i % 25, i // 25) for i in range(625)], float)
    return np.concatenate([rng.normal(size=(500, 3)), 1000 + rng.normal(size=(4, 3))])


@pytest.mark.parametrize("kind,block", [("equal_sums", 2048), ("clusters", 50), ("grid", 2048), ("outliers", 64)])
def test_tree_equals_brute_force(spark, kind, block, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    x = shapes(kind)
    copies = [3 if i % 50 == 0 else 1 for i in range(len(x))]
    rows = [(i + c * 10_000, x[i].tolist()) for i in range(len(x)) for c in range(copies[i])]
    df = spark.createDataFrame(rows, "id long, features array<double>")
    got = {r["id"]: [(round(f["distance"], 9), f["id"], f["weight"]) for f in r["found"]]
           for r in neighbours.nearest(df, 5, cell_rows=16, fan=6).collect()}
    assert len(got) == len(x)
    for i in range(len(x)):
        assert got[i] == brute(x, copies, i, 5), (kind, i)


def test_equal_sums_spread_over_balls(spark):
    x = shapes("equal_sums")
    base = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "id long, features array<double>, weight long")
    rows, levels = neighbours._planted(base, 16, 8)
    assert len(levels) == 2 and rows.groupBy("node").count().agg({"count": "max"}).first()[0] < 120


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [0.0]), (3, [5.0])], "id long, features array<double>")
    got = {r["id"]: [(f["id"], f["weight"]) for f in r["found"]] for r in neighbours.nearest(df, 5).collect()}
    assert got == {1: [(1, 1), (3, 1)], 3: [(1, 2)]}
    assert neighbours.nearest(df.where("false"), 5).count() == 0
