"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Every source gets a target number of words. Blocks of equal size are dealt to
the sources by the highest quotients target / (2k - 1), which gives integer
quotas; because the method never takes a seat back when the house grows, the
quotas of successive shards are differences of cumulative seats. A source's
documents are laid out in a seeded order and its stream is cut into blocks;
it gives its first ``quota`` blocks, starting over when the stream ends, at
most ``repeats`` times.

Defined results: null and empty texts have size 0 and are never taken; a null
source is a source that sorts last; a source without words has target 0;
repeated rows are rows of their own; an empty table gives an empty mix; other
columns are kept, but for the names this module adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwise.llm.common import running_within, seeded, stored
from panelwise.operators.ordering import dense_index

WEIGHTS = (5, 2, 1)
REPEATS = 3
SHARDS = 16


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size", weights: tuple[int, ...] = WEIGHTS,
                   repeats: int = REPEATS) -> DataFrame:
    """One row per source: position by code point (null last), weight, source_size and target.

    The targets share all words by weight. A target stops at ``repeats`` times
    its source's size and the excess is shared anew until none is above: the
    level (words per unit of weight) rises round by round; the driver sees two
    sums per round.
    """
    totals = stored(sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size")), "source-sizes")
    place = dense_index(totals, "source", "_place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    known = totals.where("source IS NOT NULL").count()
    table = stored(totals.join(place, "source", "left").select(
        "source", "source_size", F.coalesce("_place", F.lit(known)).cast("long").alias("position"))
        .withColumn("weight", weight), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, cap = 0.0, F.col("source_size") * repeats
    while total:
        full = cap < level * F.col("weight")
        fixed, free = table.agg(F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        rise = (total - fixed) / free
        if rise <= level:
            break
        level = rise
    return table.withColumn("target", F.least(cap.cast("double"), F.lit(float(level)) * F.col("weight")))


def block_size(targets: DataFrame, most: int = 1024, parts: int = 200) -> int:
    """Words per block: the smallest target gets about ``parts`` blocks, but no block is larger than ``most``."""
    least = targets.where("target > 0").agg(F.min("target")).first()[0]
    return max(1, min(most, int((least or 0) // parts)))


def quotas(targets: DataFrame, block: int, shards: int = SHARDS) -> DataFrame:
    """(position, shard, quota): blocks of each source in each shard, by highest quotients.

    Seats that every house of this size must give are counted directly; only
    the last few of each source (about two per source and shard) are ranked.
    """
    live = targets.where("target > 0").select("position", "target")
    n, total = live.agg(F.count("*"), F.sum("target")).first()
    if not n:
        return live.select("position", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("quota"))
    house = round(total / block)
    ends = [house * (j + 1) // shards for j in range(shards)]
    cumulated = F.explode(F.array(*[F.struct(F.lit(j).alias("shard"), F.lit(h).cast("long").alias("house")) for j, h in enumerate(ends)]))
    rows = live.select("position", "target", cumulated.alias("_e")).select("position", "target", "_e.*")
    share = F.col("target") / total
    sure = F.floor(share * F.greatest(F.col("house") - n / 2 - 1, F.lit(0.0)) + F.when(F.col("house") > n / 2 + 1, 0.5).otherwise(0.0))
    reach = F.floor(share * (F.col("house") + n / 2 + 1) + 0.5) + 1
    rows = stored(rows.withColumn("sure", sure.cast("long")).withColumn("reach", reach.cast("long")), "seats")
    rest = rows.groupBy("shard").agg((F.max("house") - F.sum("sure")).alias("rest"))
    seat = rows.select("position", "shard", "target", F.explode(F.sequence(F.col("sure") + 1, F.greatest("reach", F.col("sure") + 1))).alias("k"))
    order = W.partitionBy("shard").orderBy((F.col("target") / (2 * F.col("k") - 1)).desc(), "position")
    won = seat.withColumn("_r", F.row_number().over(order)).join(rest, "shard").where("_r <= rest") \
        .groupBy("position", "shard").agg(F.count("*").alias("more"))
    held = rows.join(won, ["position", "shard"], "left").withColumn("seats", F.col("sure") + F.coalesce("more", F.lit(0)))
    earlier = F.lag("seats", 1, 0).over(W.partitionBy("position").orderBy("shard"))
    return held.select("position", "shard", (F.col("seats") - earlier).alias("quota"))


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", weights: tuple[int, ...] = WEIGHTS,
        repeats: int = REPEATS, shards: int = SHARDS, block: int | None = None, seed: int = 7) -> DataFrame:
    """Every row of ``df`` with source_size, target, quota_words, stream_start and taken.

    ``df`` (a stored table) has the words of each document in ``size``.
    ``taken`` counts repeats; ``stream_start`` is where the document begins in
    its source's seeded stream, which ``pieces`` uses to fill the shards.
    """
    targets = source_targets(df, source, size, weights, repeats)
    unit = block or block_size(targets)
    won = quotas(targets, unit, shards).groupBy("position").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("shard", "quota"))), lambda x: x["quota"]).alias("shard_quotas"))
    words = F.aggregate("shard_quotas", F.lit(0).cast("long"), lambda a, x: a + x) * unit
    plan = stored(targets.join(won, "position", "left").select(
        F.col("source").alias("_source"), "source_size", "target", F.coalesce("shard_quotas", F.array().cast("array<bigint>")).alias("shard_quotas"),
        F.least(F.coalesce(words, F.lit(0)), F.col("source_size") * repeats).alias("quota_words"), F.lit(unit).cast("long").alias("block_words")), "mix-plan")
    laid = running_within(df, source, F.col(size), seeded(seed, F.col(key)), [key, size], "stream_start")
    joined = laid.join(plan, F.col(source).eqNullSafe(F.col("_source"))).drop("_source")
    passes = F.expr("quota_words div greatest(source_size, 1)")
    rest = F.col("quota_words") - passes * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col(size), rest - F.col("stream_start")))
    return joined.withColumn("taken", (passes * F.col(size) + part).cast("long"))


def pieces(mixed: DataFrame, key: str = "doc_id", size: str = "size", repeats: int = REPEATS) -> DataFrame:
    """(key, pass, shard, first_word, words): which words of a document go to which shard in which pass over its source."""
    starts = mixed.withColumn("_ends", F.transform(
        F.sequence(F.lit(1), F.size("shard_quotas")), lambda j: F.aggregate(F.slice("shard_quotas", 1, j), F.lit(0).cast("long"), lambda a, x: a + x)
        * F.col("block_words"))).where((F.col("taken") > 0) & (F.size("shard_quotas") > 0))
    each = starts.select(key, size, "_ends", "quota_words", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(repeats - 1)), lambda p: F.col("stream_start") + p * F.col("source_size"))).alias("pass", "_at"))
    spans = F.transform("_ends", lambda e, j: F.struct(
        j.alias("shard"), F.greatest(F.col("_at"), F.when(j > 0, F.element_at("_ends", F.greatest(j, F.lit(1)))).otherwise(F.lit(0))).alias("low"),
        F.least(F.col("_at") + F.col(size), e, F.col("quota_words")).alias("high")))
    return each.withColumn("_s", F.explode(F.filter(spans, lambda x: x["low"] < x["high"]))).select(
        key, "pass", "_s.shard", (F.col("_s.low") - F.col("_at")).alias("first_word"), (F.col("_s.high") - F.col("_s.low")).alias("words"))
