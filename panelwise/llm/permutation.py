"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order in which it sees a fixed set of pivots.
It is posted in the inverted files of its ``posts`` nearest pivots; a query
visits the files of its ``probes`` nearest pivots, ranks what it finds there
by the footrule distance of the two orders, and computes true distances for
all entries whose footrule is at most ``cut`` times the typical footrule of
unrelated vectors (measured between the pivots). No count limits the
candidates.

A query that the pivots say little about stays open after that: one that has
fewer than ``LEAST`` candidates per wanted row, or is further from its nearest
pivot than ``FAR`` times the median of the indexed vectors (shifted or scaled
vectors see all data in nearly the same order). Open queries are compared with
every vector, in blocks, and are exact; so every query gets k rows where there
are as many candidates.

Pivots are a bounded sample (``pivots`` vectors by a hash of their ids); every
vector is indexed. A file is dealt out in blocks of about ``BLOCK`` entries,
and the queries that visit it in blocks as well, so a popular pivot is many
small tasks, each of which returns at most k + 1 entries per query. Equal
vectors are one entry with the ids that can matter.

Defined results: vectors that are null, of another length than most, zero, or
hold null or non-finite components take no part; with fewer candidates than k
all that were found are returned; equal distances go to the smaller id; rows
that repeat id and vector are one; an empty table gives no rows; other
columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwise.llm.common import seeded, small_batches, stored

PIVOTS = 128
POSTS = 4
PROBES = 48
CUT = 0.95
LEAST = 10
FAR = 1.5
BLOCK = 4096
QUERY_BLOCK = 512

RESULT = "query_id long, rank int, vec_id long, score double"


def proper(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec) of the rows whose vector takes part."""
    vec = F.col(vector).cast("array<double>")
    good = F.col(key).isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) \
        & F.exists(vec, lambda x: x != 0)
    rows = df.where(F.coalesce(good, F.lit(False))).select(F.col(key).cast("long").alias("id"), vec.alias("vec"))
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vec") == (sizes["n"] if sizes else 0))


def _squares(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return (vectors ** 2).sum(1)[:, None] + (pivots ** 2).sum(1) - 2 * vectors @ pivots.T


def orders(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For each vector the pivots from nearest to farthest; equal distances by pivot number."""
    return np.argsort(_squares(vectors, pivots), axis=1, kind="stable").astype(np.int16)


def places(order: np.ndarray) -> np.ndarray:
    """Place of every pivot in each order."""
    out = np.empty_like(order)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.int16)[None, :].repeat(len(order), 0), axis=1)
    return out


def _matrix(values: pa.Array, n: int, width: int) -> np.ndarray:
    return np.asarray(values.flatten(), dtype=np.float64).reshape(n, width)


def _ordered(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``order``, the numbers of all pivots from nearest to farthest, and ``near``, the distance to the nearest."""
    width = pivots.shape[1]

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vec"), batch.num_rows, width)
            seen = orders(vectors, pivots)
            near = np.sqrt(np.maximum(_squares(vectors, pivots), 0).min(axis=1, initial=np.inf))
            ends = pa.array(np.arange(0, seen.size + 1, seen.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("vec"), pa.ListArray.from_arrays(ends, pa.array(seen.ravel(), pa.int16())), pa.array(near)],
                                             ["rep", "vec", "order", "near"])

    return df.select("rep", "vec").mapInArrow(sort, "rep long, vec array<double>, order array<short>, near double")


def nearest(df: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS,
            posts: int = POSTS, probes: int = PROBES, cut: float = CUT, seed: int = 3) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row, with Euclidean distances in double precision."""
    spark = df.sparkSession
    small_batches(spark)
    rows = stored(proper(df, key, vector).distinct(), "vectors")
    asked = stored(proper(queries, key, vector).distinct(), "query-vectors")
    first = F.row_number().over(W.partitionBy("vec").orderBy("id"))
    entries = stored(rows.withColumn("_rn", first).where(F.col("_rn") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
                     .withColumn("rep", F.col("ids")[0]), "distinct-vectors")
    sample = entries.orderBy(seeded(seed, F.col("rep")), "rep").limit(pivots).select("vec").collect()
    if not sample:
        return spark.createDataFrame([], RESULT)
    centres = np.array([r["vec"] for r in sample])
    n_pivots = len(centres)
    posts, probes = min(posts, n_pivots), min(probes, n_pivots)
    own = places(orders(centres, centres)).astype(np.int32)
    apart = np.abs(own[:, None, :] - own[None, :, :]).sum(axis=2)[np.triu_indices(n_pivots, 1)]
    limit = float(cut * np.median(apart)) if len(apart) else np.inf
    if n_pivots < pivots:  # fewer vectors than pivots: the index would hold nothing but the pivots
        limit, posts, probes = np.inf, n_pivots, n_pivots

    index = stored(_ordered(entries, centres), "permutations")
    wanted = asked.select("vec").distinct().join(entries.select("vec", "rep"), "vec")
    wanted = stored(_ordered(wanted, centres), "query-permutations")
    posted = index.select("rep", "vec", "order", F.explode(F.slice("order", 1, posts)).alias("pivot"))
    visits = wanted.select("rep", "vec", "order", F.explode(F.slice("order", 1, probes)).alias("pivot"))
    blocks = _blocks(posted, BLOCK)
    query_blocks = _blocks(visits, QUERY_BLOCK)

    def dealt(side: DataFrame, mine: dict[int, int], other: dict[int, int], names: tuple[str, str]) -> DataFrame:
        """Each row in one block of its own side, copied to every block of the other side."""
        count = F.element_at(F.array(*[F.lit(mine.get(p, 1)) for p in range(n_pivots)]), F.col("pivot") + 1)
        copies = F.element_at(F.array(*[F.lit(other.get(p, 0)) for p in range(n_pivots)]), F.col("pivot") + 1)
        return side.withColumn(names[0], F.pmod(F.xxhash64("rep"), count).cast("int")).where(copies > 0) \
            .withColumn(names[1], F.explode(F.sequence(F.lit(0), copies - 1)))

    left = dealt(visits, query_blocks, blocks, ("qb", "vb"))
    right = dealt(posted, blocks, query_blocks, ("vb", "qb"))

    def search(group: tuple, mine: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = []
        if len(mine) and len(found):
            pivot = int(group[0])
            vectors, order = np.vstack(found["vec"].to_numpy()), np.vstack(found["order"].to_numpy())
            place, reps = places(order), found["rep"].to_numpy()
            for rep, vec, seen in zip(mine["rep"], mine["vec"], mine["order"]):
                visited = np.zeros(n_pivots, bool)
                visited[seen[:probes]] = True
                hits = visited[order[:, :posts]]
                here = order[np.arange(len(order)), hits.argmax(axis=1)] == pivot  # each entry in the first file it shares with the query
                mine_place = places(np.asarray(seen, np.int16)[None, :])[0]
                take = np.flatnonzero(here)
                take = take[np.abs(place[take] - mine_place).sum(axis=1, dtype=np.int32) <= limit]
                if not len(take):
                    continue
                out.append(_closest(rep, np.asarray(vec), vectors[take], reps[take], k))
        return _found(out)

    by = ("pivot", "vb", "qb")
    hits = stored(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(search, FOUND), "close-vectors")
    typical = index.agg(F.percentile_approx("near", 0.5)).first()[0]
    seen = hits.groupBy("query").agg(F.sum("seen").alias("seen"))
    few = F.coalesce("seen", F.lit(0)) < LEAST * (k + 1)
    hard = stored(wanted.join(seen, F.col("query") == F.col("rep"), "left").where(few | (F.col("near") > FAR * typical)).select("rep", "vec"), "open-queries")
    close = hits.select("query", "rep", "score").where("rep IS NOT NULL")
    n_hard = hard.count()
    if n_hard:
        close = close.join(hard.select(F.col("rep").alias("query")), "query", "left_anti").unionByName(_exhaustive(index, hard, n_hard, k))
    top = F.row_number().over(W.partitionBy("query").orderBy("score", "rep"))
    best = stored(close.withColumn("_rn", top).where(F.col("_rn") <= k + 1).drop("_rn"), "nearest-vectors")
    ids = best.join(entries.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    asked_ids = asked.join(entries.select("vec", "rep"), "vec").select(F.col("id").alias("query_id"), F.col("rep").alias("query"))
    rank = F.row_number().over(W.partitionBy("query_id", "query").orderBy("score", "vec_id"))
    return asked_ids.join(ids, "query").where("vec_id <> query_id").withColumn("rank", rank).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


#: What a block of a file gives a query: its nearest entries, and in the first row how many candidates it had.
FOUND = "query long, rep long, score double, seen long"


def _closest(query: int, vec: np.ndarray, vectors: np.ndarray, reps: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k + 1 entries nearest to a query (itself may be one), equal distances by id, as the columns of ``FOUND``."""
    exact = np.sqrt(((vectors - vec) ** 2).sum(axis=1))
    near = np.arange(len(exact))
    if len(near) > k + 1:
        near = np.flatnonzero(exact <= np.partition(exact, k)[k])
        near = near[np.lexsort((reps[near], exact[near]))][:k + 1]
    return np.full(len(near), query), reps[near], exact[near], np.where(np.arange(len(near)) == 0, len(exact), 0)


def _found(out: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
    if not out:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
    return pd.DataFrame({name: np.concatenate([x[i] for x in out]) for i, name in enumerate(("query", "rep", "score", "seen"))})


def _exhaustive(index: DataFrame, hard: DataFrame, n_hard: int, k: int) -> DataFrame:
    """(query, rep, score): nearest entries of the open queries among all entries, block by block on both sides."""
    blocks, query_blocks = -(-index.count() // BLOCK), -(-n_hard // QUERY_BLOCK)

    def dealt(side: DataFrame, own: str, n: int, other: str, copies: int) -> DataFrame:
        return side.select("rep", "vec", F.pmod(F.xxhash64("rep"), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other))

    def search(mine: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(entries):
            return _found([])
        vectors, reps = np.vstack(entries["vec"].to_numpy()), entries["rep"].to_numpy()
        return _found([_closest(rep, np.asarray(vec), vectors, reps, k) for rep, vec in zip(mine["rep"], mine["vec"])])

    left, right = dealt(hard, "qb", query_blocks, "vb", blocks), dealt(index, "vb", blocks, "qb", query_blocks)
    return left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(search, FOUND).select("query", "rep", "score")


def _blocks(side: DataFrame, size: int) -> dict[int, int]:
    """Number of blocks of every pivot; the driver gets one row per pivot."""
    return {r["pivot"]: -(-r["count"] // size) for r in side.groupBy("pivot").count().collect()}
