"""Exact nearest neighbours and the local outlier factor by a metric tree.

Equal vectors are collapsed to one weighted row. Rows are put into balls, each
level of the tree splitting a ball among sampled pivots; the depth follows
from the number of rows, so balls stay small at any size. A row first searches
its own ball, which bounds its k-th distance, then goes down the tree and
keeps only balls that the triangle inequality allows to hold something nearer.
Where rows of a ball or of a search are many, both sides are dealt in hashed
blocks: a task sees one block of each, whatever the shape of the data.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwise.session import cut_lineage, written

#: Rows of a ball the tree aims at, children of a ball at most, rows of a block.
CELL_ROWS, FAN, BLOCK = 256, 128, 2048


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``features``: columns with zero mean and unit population spread."""
    stats = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns])
    parts = []
    for c in columns:
        m, s = stats.select(f"{c}.m").scalar(), stats.select(f"{c}.s").scalar()
        parts.append(F.coalesce(F.try_divide(F.col(c) - m, s), F.lit(0.0)))
    return df.withColumn("features", F.array(*parts))


def _take(found: Column, k: int) -> Column:
    """Sorted (distance, id, weight) entries until their weights reach k."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<distance:double,id:bigint,weight:bigint>>").alias("kept"))
    return F.aggregate(F.array_sort(found), start, lambda a, x: F.when(a["n"] >= k, a).otherwise(F.struct(
        (a["n"] + x["weight"]).alias("n"), F.array_append(a["kept"], F.struct(
            x["distance"].alias("distance"), x["id"].alias("id"), F.least(x["weight"], k - a["n"]).alias("weight"))).alias("kept"))), lambda a: a["kept"])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((b - a) ** 2).sum(axis=1))


def _paired(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a cogroup on ``key`` with columns lb and rb: hashed blocks of about ``BLOCK`` rows, each row copied to the blocks of the other side."""
    sizes = left.groupBy(key).agg(F.count("*").alias("_l")).join(right.groupBy(key).agg(F.count("*").alias("_r")), key) \
        .select(key, F.ceil(F.col("_l") / BLOCK).cast("int").alias("_lb"), F.ceil(F.col("_r") / BLOCK).cast("int").alias("_rb"))
    sizes = written(sizes)

    def dealt(side: DataFrame, own: str, other: str, mine: str, copied: str) -> DataFrame:
        place = F.pmod(F.xxhash64("rid"), F.col(own)).cast("int").alias(mine)
        return side.join(sizes, key).select(*side.columns, place, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(copied))

    return dealt(left, "_lb", "_rb", "lb", "rb"), dealt(right, "_rb", "_lb", "rb", "lb")


def _cogrouped(left: DataFrame, right: DataFrame, key: str, function, schema: str) -> DataFrame:
    a, b = _paired(left, right, key)
    names = b.columns
    b = b.toDF(*[f"{c}_r" for c in names])  # both sides may come from one table
    return a.groupBy(key, "lb", "rb").cogroup(b.groupBy(f"{key}_r", "lb_r", "rb_r")).applyInPandas(lambda x, y: function(x, y.set_axis(names, axis=1)), schema)


def _planted(base: DataFrame, cell_rows: int, fan: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rows (rid, features, weight, node) with their ball, and per level the balls (node = parent, rid, pivot, radius, weight)."""
    n = base.count()
    depth = math.ceil(math.log(max(n / cell_rows, 1)) / math.log(fan))
    rows, levels = base.select(F.col("id").alias("rid"), "features", "weight", F.lit(0).cast("long").alias("node")), []

    def assign(mine: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or pivots.empty:
            return pd.DataFrame({"rid": [], "features": [], "weight": [], "parent": [], "node": [], "far": []})
        centres, ids = np.stack(pivots["features"].to_numpy()), pivots["rid"].to_numpy()
        apart = [_apart(x, centres) for x in np.stack(mine["features"].to_numpy())]
        best = [int(d.argmin()) for d in apart]
        return pd.DataFrame({"rid": mine["rid"], "features": mine["features"], "weight": mine["weight"], "parent": mine["node"],
                             "node": ids[best], "far": [d[i] for d, i in zip(apart, best)]})

    for _ in range(depth):
        wanted = rows.groupBy("node").agg(F.least(F.lit(fan), F.ceil(F.count("*") / cell_rows)).cast("int").alias("wanted"))
        drawn = F.row_number().over(W.partitionBy("node").orderBy(F.xxhash64("rid", F.lit(len(levels))), "rid"))
        pivots = written(rows.withColumn("_k", drawn).where(F.col("_k") <= fan).join(wanted, "node").where("_k <= wanted").select("node", "rid", "features"))
        # a pivot is copied to all blocks of its ball, since it is a right side of one block
        rows = written(_cogrouped(rows, pivots, "node", assign, "rid long, features array<double>, weight long, parent long, node long, far double"))
        balls = rows.groupBy("parent", "node").agg(F.max("far").alias("radius"), F.sum("weight").alias("weight"))
        levels.append(written(balls.join(pivots.select(F.col("rid").alias("node"), F.col("features").alias("pivot")), "node")
                              .select(F.col("parent").alias("node"), F.col("node").alias("rid"), "pivot", "radius", "weight")))
        rows = rows.select("rid", "features", "weight", "node")
    return rows, levels


def nearest(points: DataFrame, k: int, cell_rows: int = CELL_ROWS, fan: int = FAN) -> DataFrame:
    """For every distinct vector: id (smallest of its copies), weight, features, and its k nearest with weights.

    ``points`` has (id bigint, features array<double>). A row's own copies
    count as neighbours at distance zero.
    """
    base = written(points.groupBy("features").agg(F.min("id").alias("id"), F.count("*").alias("weight")))
    rows, levels = _planted(base, cell_rows, fan)
    rows = written(rows)
    none = F.array().cast("array<struct<distance:double,id:bigint,weight:bigint>>")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if not left.empty and not right.empty:
            b, ids, weights = np.stack(right["features"].to_numpy()), right["rid"].to_numpy(), right["weight"].to_numpy()
            for qid, row in zip(left["rid"].to_numpy(), np.stack(left["features"].to_numpy())):
                dist = _apart(row, b)
                near = np.flatnonzero(dist <= np.partition(dist, k)[k]) if len(dist) > k + 1 else np.arange(len(dist))
                near = near[np.lexsort((ids[near], dist[near]))][:k + 1]
                left_over = weights[near] - (ids[near] == qid)
                near, left_over = near[left_over > 0][:k], left_over[left_over > 0][:k]
                out.append((np.full(len(near), qid), dist[near], ids[near], left_over))
        if not out:
            out = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        return pd.DataFrame({name: np.concatenate([x[i] for x in out]) for i, name in enumerate(("qid", "distance", "id", "weight"))})

    def searched(asked: DataFrame) -> DataFrame:
        """(rid, new) of asked (rid, features, node): the nearest in those balls, block by block."""
        hits = _cogrouped(asked, rows, "node", search, "qid long, distance double, id long, weight long")
        return hits.groupBy(F.col("qid").alias("rid")).agg(F.collect_list(F.struct("distance", "id", "weight")).alias("new"))

    own = searched(rows.select("rid", "features", "node"))
    first = written(rows.select("rid", "features", "node").join(own, "rid", "left").withColumn("found", _take(F.coalesce("new", none), k)).drop("new"))
    if levels:
        full = F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x["weight"]) >= k
        bound = F.when(full, F.element_at("found", -1)["distance"]).otherwise(F.lit(float("inf")))
        open_at = first.select("rid", "features", F.lit(0).cast("long").alias("node"), bound.alias("bound"))

        def descend(left: pd.DataFrame, balls: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple] = []
            if not left.empty and not balls.empty:
                pivots, ids = np.stack(balls["pivot"].to_numpy()), balls["rid"].to_numpy()
                radius, enough = balls["radius"].to_numpy(), balls["weight"].to_numpy() > k
                for i, (row, most) in enumerate(zip(left["features"], left["bound"])):
                    dist = _apart(np.asarray(row), pivots)
                    most = min(most, (dist + radius)[enough].min(initial=np.inf))
                    # rounding may not close a ball that lies exactly at the bound
                    hit = np.flatnonzero(dist - radius <= most + 1e-9 * (1 + dist))
                    out.append((np.full(len(hit), i), ids[hit], np.full(len(hit), most)))
            if not out:
                return pd.DataFrame({"rid": [], "features": [], "node": [], "bound": []})
            at = np.concatenate([x[0] for x in out])
            return pd.DataFrame({"rid": left["rid"].to_numpy()[at], "features": left["features"].to_numpy()[at],
                                 "node": np.concatenate([x[1] for x in out]), "bound": np.concatenate([x[2] for x in out])})

        for balls in levels:
            open_at = written(_cogrouped(open_at, balls, "node", descend, "rid long, features array<double>, node long, bound double"))
        more = searched(open_at.join(first.select("rid", "node"), ["rid", "node"], "left_anti").select("rid", "features", "node"))
        first = first.join(more, "rid", "left").withColumn("found", _take(F.concat("found", F.coalesce("new", none)), k))
    return first.select(F.col("rid").alias("id"), "found").join(base, "id")


def local_outlier_factor(points: DataFrame, k: int = 20) -> DataFrame:
    """(id, lof) for every row; equal vectors share their value."""
    near = cut_lineage(nearest(points, k))
    kdist = near.select("id", F.element_at("found", -1)["distance"].alias("kdist"))
    links = near.select(F.col("id").alias("pid"), F.explode("found").alias("n")).select("pid", "n.distance", F.col("n.id").alias("id"), "n.weight")
    reach = links.join(kdist, "id").withColumn("reach", F.greatest("kdist", "distance"))
    lrd = reach.groupBy("pid").agg((1.0 / (F.sum(F.col("reach") * F.col("weight")) / F.sum("weight") + 1e-10)).alias("lrd"))
    own = lrd.select(F.col("pid"), F.col("lrd").alias("own"))
    other = links.join(lrd.withColumnRenamed("pid", "id"), "id").groupBy("pid").agg((F.sum(F.col("lrd") * F.col("weight")) / F.sum("weight")).alias("others"))
    by_vector = near.select(F.col("id").alias("pid"), "features").join(other, "pid").join(own, "pid").select("features", (F.col("others") / F.col("own")).alias("lof"))
    return points.join(by_vector, "features").select("id", "lof")


def oversample(minority: DataFrame, factor: int, k: int = 5, seed: int = 3) -> DataFrame:
    """Synthetic minority rows between a row and one of its nearest neighbours, ``factor`` per row."""
    near = cut_lineage(nearest(minority, k))
    draws = near.where(F.size("found") > 0).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(factor))))
    h = F.xxhash64(F.lit(seed), F.col("id"), F.col("draw"))
    pick = draws.withColumn("nid", F.get("found", F.pmod(h, F.size("found")).cast("int"))["id"]) \
        .withColumn("u", F.pmod(F.shiftright(h, 20), F.lit(10_000)) / 10_000.0)
    other = near.select(F.col("id").alias("nid"), F.col("features").alias("nf"))
    return pick.join(other, "nid").select("id", "draw", F.transform(F.arrays_zip("features", "nf"), lambda z: z["features"] + F.col("u") * (z["nf"] - z["features"])).alias("features"))

