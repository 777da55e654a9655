"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.session import written


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge: component is the smallest node id that can be reached.

    The graph shrinks in every round: each node moves to the neighbour with the
    smallest hash of the round, unless its own is smaller; edges are renamed to
    the nodes moved to, and copies and loops are dropped. A round leaves about
    half of the nodes of a chain and fewer of denser graphs, so all rounds
    together shuffle a small multiple of the edges, in any order of ids. It
    runs until no edge is left; there is no limit on the rounds. The moves are
    then followed backwards from the last round. A node with very many
    neighbours is aggregated before the shuffle.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    both = written(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    near, moves = both.where("u < v"), []
    while not near.isEmpty():
        moves.append(written(_moves(near, len(moves)), "moves"))
        near = written(_renamed(near, moves[-1]), "edges")
    root = None
    for step in reversed(moves):
        if root is not None:
            later = root.select(F.col("node").alias("to"), "root")
            step = step.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
            root = written(step, "roots")
        else:
            root = step.select("node", F.col("to").alias("root"))
    alone = both.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    if root is None:
        return alone
    least = root.groupBy("root").agg(F.min("node").alias("component"))
    found = root.join(least, "root").select("node", "component")
    return found.unionByName(alone.join(found.select("node"), "node", "left_anti"))


def _moves(near: DataFrame, round_no: int) -> DataFrame:
    """(node, to) of a round: the node with the smallest hash among a node and its neighbours."""
    def order(c: str) -> Column:
        return F.hash(F.lit(round_no), c)

    ends = near.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other")))))
    best = ends.groupBy("node").agg(F.min_by("other", order("other")).alias("other"))
    return best.select("node", F.when(order("other") < order("node"), F.col("other")).otherwise(F.col("node")).alias("to"))


def _renamed(near: DataFrame, moves: DataFrame) -> DataFrame:
    """Edges between the nodes that their ends moved to, each once."""
    gone = moves.where("node <> to")
    to_u, to_v = (gone.select(F.col("node").alias(c), F.col("to").alias(f"p{c}")) for c in "uv")
    both = near.join(to_u, "u", "left").withColumn("u", F.coalesce("pu", "u")).drop("pu") \
        .join(to_v, "v", "left").withColumn("v", F.coalesce("pv", "v")).where("u <> v")
    return both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
